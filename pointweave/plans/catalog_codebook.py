"""Queries over codebooks: assignment, reconstruction, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointweave.functions.vec import as_double, dot, l2_normalize, norm
from pointweave.operators import codebook as cb
from pointweave.operators import sample
from pointweave.operators.consensus import vector_sum
from pointweave.plans.registry import POINTS, Inputs, query
from pointweave.plans.sqltext import mix, unit, vsum

_CODES = "SELECT vec_id AS code_id, embedding AS vec FROM {embeddings} WHERE vec_id < 32"
_DOT = "list_dot_product(p.vec::DOUBLE[], c.vec::DOUBLE[])"
_L2 = "list_sum(list_transform(list_zip(p.vec::DOUBLE[], c.vec::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: Points refer to two levels of eight codes each; every seventh lacks the second.
_SLOTS = "SELECT vec_id AS gid, 0 AS slot, vec_id % 8 AS code_id, 255 AS weight FROM {embeddings} UNION ALL SELECT vec_id, 1, 8 + vec_id % 5, 64 + vec_id % 100 FROM {embeddings} WHERE vec_id % 7 <> 0"


def _codes(t: Inputs) -> DataFrame:
    return t(_CODES).withColumn("vec", as_double("vec"))


@query(f"""WITH p AS ({POINTS}), c AS ({_CODES}), s AS (SELECT gid, code_id, {_DOT} AS s FROM p, c)
SELECT gid, code_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY gid ORDER BY s DESC, code_id) = 1""")
def nearest_code(t: Inputs) -> DataFrame:
    """C8 (dot)"""
    return cb.nearest_code(t(POINTS), _codes(t)).select("gid", "code_id", F.round("score", 6).alias("score"))


@query(f"""WITH p AS ({POINTS}), c AS ({_CODES}), s AS (SELECT gid, code_id, {_L2} AS s FROM p, c)
SELECT gid, code_id FROM s QUALIFY row_number() OVER (PARTITION BY gid ORDER BY s, code_id) = 1""")
def nearest_code_l2(t: Inputs) -> DataFrame:
    """C8 (Euclidean)"""
    return cb.nearest_code(t(POINTS), _codes(t), "l2").select("gid", "code_id")


def _rec(weight: str) -> str:
    return f"""WITH k AS ({_SLOTS}), c AS ({_CODES}), x AS (SELECT gid, pos, sum(w * val) AS s FROM (SELECT gid, {weight} AS w, generate_subscripts(vec, 1) AS pos, unnest(vec::DOUBLE[]) AS val FROM k JOIN c USING (code_id)) u GROUP BY ALL),
n AS (SELECT gid, sqrt(sum(s * s)) AS len FROM x GROUP BY 1) SELECT gid, round(s / greatest(len, 1e-8), 6) AS first, round(len, 6) AS length FROM x JOIN n USING (gid) WHERE pos = 1"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("gid", F.round(l2_normalize("feature")[0], 6).alias("first"), F.round(norm("feature"), 6).alias("length"))


@query(_rec("1"))
def residual_reconstruct(t: Inputs) -> DataFrame:
    """J5, J7"""
    return _shown(cb.reconstruct(t(_SLOTS), _codes(t), ["gid"], ["code_id"], normalise=False))


@query(_rec("weight / 255.0"))
def slot_weighted_reconstruct(t: Inputs) -> DataFrame:
    """J6, S16"""
    slots = t(_SLOTS).withColumn("w", F.col("weight") / 255.0)
    return _shown(cb.reconstruct(slots, _codes(t), ["gid"], ["code_id"], "w", normalise=False))


@query("""WITH l AS (SELECT vec_id % 3 AS level, vec_id // 3 AS code_id FROM {embeddings} WHERE vec_id < 50), o AS (SELECT level, coalesce(sum(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT level, max(code_id) + 1 AS n FROM l GROUP BY 1))
SELECT vec_id AS gid, s.level AS slot, (vec_id % 10 + off)::BIGINT AS code_id FROM {embeddings}, (SELECT unnest(range(0, 3)) AS level) s JOIN o ON o.level = s.level""")
def codebook_merge_offsets(t: Inputs) -> DataFrame:
    """U3, U4"""
    codes = t("SELECT vec_id % 3 AS level, vec_id div 3 AS code_id, embedding AS vec FROM {embeddings} WHERE vec_id < 50")
    ids = t("SELECT vec_id AS gid, vec_id % 10 AS code_id, explode(sequence(0L, 2L)) AS level FROM {embeddings}")
    return cb.merge_levels(codes, ids)[1].select("gid", "slot", "code_id")


@query(f"WITH k AS ({_SLOTS}) SELECT gid, slot, code_id FROM k WHERE gid IN (SELECT vec_id FROM {{embeddings}} WHERE label < 4)")
def prune_keepmask(t: Inputs) -> DataFrame:
    """J20, J21, P30"""
    return cb.prune(t(_SLOTS), t("SELECT vec_id AS gid FROM {embeddings} WHERE label < 4")).select("gid", "slot", "code_id")


@query(f"WITH k AS ({_SLOTS}), v AS (SELECT gid, count(DISTINCT slot) AS n FROM k GROUP BY 1) SELECT gid, n = 2 AS every FROM v")
def valid_codes(t: Inputs) -> DataFrame:
    """Valid rules of residual (all levels) and shared (any slot) artifacts."""
    k = t(_SLOTS)
    every = cb.valid_points(k, 2).withColumn("every", F.lit(True))
    return cb.valid_points(k, 2, "any").join(every, "gid", "left").select("gid", F.coalesce("every", F.lit(False)).alias("every"))


@query(f"WITH k AS ({_SLOTS}), s AS (SELECT code_id AS group_id, sum(weight / 255.0) AS plain FROM k GROUP BY 1) SELECT group_id, round(plain, 6) AS plain, round((plain + 1) / avg(plain + 1) OVER (), 6) AS relative FROM s")
def usage_stats(t: Inputs) -> DataFrame:
    """A15"""
    u = cb.usage(t(_SLOTS).select(F.col("code_id").alias("group_id"), (F.col("weight") / 255.0).alias("s")), "group_id", "s")
    return u.select("group_id", F.round("plain", 6).alias("plain"), F.round("relative", 6).alias("relative"))


@query(f"WITH k AS ({_SLOTS}), c AS ({_CODES}) SELECT code_id FROM c WHERE code_id NOT IN (SELECT code_id FROM k)")
def dead_codes(t: Inputs) -> DataFrame:
    """A16"""
    return cb.dead_codes(t(_CODES), t(_SLOTS))


@query(f"""WITH p AS ({POINTS}), c AS (SELECT gid AS code_id, vec FROM p WHERE gid < 8), s AS (SELECT gid, p.vec, code_id, {_DOT} AS s FROM p, c), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY gid ORDER BY s DESC, code_id) = 1),
x AS (SELECT code_id, pos, sum(val) AS s, count(*) AS n FROM (SELECT code_id, generate_subscripts(vec, 1) AS pos, unnest(vec::DOUBLE[]) AS val FROM a) u GROUP BY ALL), k AS (SELECT code_id, sqrt(sum(s * s)) AS len, max(n) AS n FROM x GROUP BY 1)
SELECT x.code_id, round(x.s / k.len, 6) AS first, k.n::DOUBLE AS n FROM x JOIN k ON k.code_id = x.code_id WHERE pos = 1""")
def kmeans_fixed_init_1_iter(t: Inputs) -> DataFrame:
    """One round from the points of lowest id"""
    p = t(POINTS)
    codes = p.where("gid < 8").select(F.col("gid").alias("code_id"), as_double("vec").alias("vec"))
    new = cb.update_codes(p, cb.nearest_code(p, codes), codes, True)
    return new.select("code_id", F.round(F.col("vec")[0], 6).alias("first"), "n")


@query()
def kmeans_full(t: Inputs) -> DataFrame:
    """Unit centres, every point at its nearest"""
    p = t(POINTS)
    codes = cb.kmeans(p, 10, 10, empty="farthest")
    n = cb.nearest_code(p, codes).groupBy("code_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("cos"))
    return codes.join(n, "code_id").select("code_id", "n", "cos", F.round(norm("vec"), 6).alias("length"))


@query()
def residual_codebook(t: Inputs) -> DataFrame:
    """C6"""
    p = t(POINTS)
    codes, ids = cb.residual_quantise(p, [16, 16], 6)
    rec = cb.reconstruct(ids, codes, ["gid"], ["level", "code_id"])
    return rec.join(p, "gid").agg(F.round(F.avg(dot("feature", "vec")), 4).alias("cos"), F.count("*").alias("n"))


@query()
def sparse_coding_slots(t: Inputs) -> DataFrame:
    """C9"""
    rows = cb.sparse_code(t(POINTS).withColumn("cap", F.lit(2)), _codes(t), 3, 0.01, 0.95, "cap")
    return rows.groupBy("gid").agg(F.count("*").alias("slots"), F.max("weight").alias("top"), F.min("code_id").alias("least"))


@query("""WITH c AS (SELECT vec_id AS gid, s.sub, (vec_id * 7 + s.sub * 3) % 9 AS code FROM {embeddings}, (SELECT unnest(range(0, 4)) AS sub) s), e AS (SELECT vec_id % 9 AS code, vec_id // 9 AS sub, embedding[1:4]::DOUBLE[] AS v FROM {embeddings} WHERE vec_id < 36),
j AS (SELECT gid, sub, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM c JOIN e USING (sub, code)), n AS (SELECT gid, sqrt(sum(x * x)) AS len FROM j GROUP BY 1)
SELECT gid, round(x / len, 6) AS tenth FROM j JOIN n USING (gid) WHERE sub = 2 AND pos = 2""")
def pq_decode(t: Inputs) -> DataFrame:
    """S4"""
    c = t("SELECT vec_id AS gid, s.sub, (vec_id * 7 + s.sub * 3) % 9 AS code FROM {embeddings} LATERAL VIEW explode(sequence(0L, 3L)) s AS sub")
    e = t("SELECT vec_id % 9 AS code, vec_id div 9 AS sub, slice(embedding, 1, 4) AS vec FROM {embeddings} WHERE vec_id < 36").withColumn("vec", as_double("vec"))
    return cb.pq_decode(c, e).select("gid", F.round(F.col("vec")[9], 6).alias("tenth"))


@query("""WITH p AS (SELECT vec_id AS gid, s.sub, list_slice(embedding, (s.sub * 16 + 1)::BIGINT, (s.sub * 16 + 16)::BIGINT)::DOUBLE[] AS v FROM {embeddings}, (SELECT unnest(range(0, 4)) AS sub) s), e AS (SELECT vec_id % 8 AS code, vec_id // 8 AS sub, embedding[1:16]::DOUBLE[] AS c FROM {embeddings} WHERE vec_id < 32),
d AS (SELECT gid, sub, code, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN e USING (sub)) SELECT gid, sub, code FROM d QUALIFY row_number() OVER (PARTITION BY gid, sub ORDER BY d, code) = 1""")
def pq_encode(t: Inputs) -> DataFrame:
    """S5"""
    e = t("SELECT vec_id % 8 AS code, vec_id div 8 AS sub, slice(embedding, 1, 16) AS vec FROM {embeddings} WHERE vec_id < 32")
    return cb.pq_encode(t(POINTS), e, 4).select("gid", F.col("sub").cast("long").alias("sub"), "code")


@query(f"""WITH p AS ({POINTS}), k AS (SELECT gid, gid % 12 AS g, (gid % 5 + 1) / 6.0 AS s FROM p UNION ALL SELECT gid, 12 + gid % 4, (gid % 3 + 1) / 5.0 FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s DESC, g) - 1 AS slot FROM k)
SELECT gid, slot::INT AS slot, g, round_even(255 * s / sum(s) OVER (PARTITION BY gid), 0)::INT AS u8 FROM r WHERE slot < 2""")
def compact_hierarchy(t: Inputs) -> DataFrame:
    """C19"""
    k = t(f"SELECT gid, gid % 12 AS g, CAST(gid % 5 + 1 AS DOUBLE) / 6 AS s FROM ({POINTS}) UNION ALL SELECT gid, 12 + gid % 4, CAST(gid % 3 + 1 AS DOUBLE) / 5 FROM ({POINTS})")
    r = k.withColumn("slot", F.row_number().over(Window.partitionBy("gid").orderBy(F.col("s").desc(), "g")) - 1).where("slot < 2")
    return r.select("gid", F.col("slot").cast("int").alias("slot"), "g", F.rint(255 * F.col("s") / F.sum("s").over(Window.partitionBy("gid"))).cast("int").alias("u8"))


@query()
def split_groups(t: Inputs) -> DataFrame:
    """C14: two-means of the most dispersed groups"""
    p = t(POINTS).withColumnRenamed("label", "group_id")
    g = vector_sum(p, ["group_id"], "vec").select(F.col("group_id").cast("long").alias("group_id"), l2_normalize("s").alias("vec"), (1 - norm("s") / F.col("total_w")).alias("dispersion"))
    out = cb.split_groups(p.withColumn("group_id", F.col("group_id").cast("long")), g, 0.0, 4, 0.5)
    return out.select("parent", "child", "n", F.round(norm("vec"), 6).alias("length"))


@query("SELECT vec_id AS gid, label FROM {embeddings} WHERE vec_id % 4 = 1 AND vec_id NOT IN (SELECT vec_id FROM {embeddings} WHERE label = 3)")
def shard_missing_only(t: Inputs) -> DataFrame:
    """S18, J22"""
    p = t("SELECT vec_id AS gid, label FROM {embeddings}")
    return sample.missing_only(sample.shard(p, "gid", 4, 1), p.where("label = 3"), "gid")


@query("SELECT s_name AS name, (row_number() OVER (ORDER BY s_name) - 1) % 8 = 0 AS test FROM {supplier}")
def train_test_split(t: Inputs) -> DataFrame:
    """K14"""
    return sample.every_nth(t("SELECT s_name AS name FROM {supplier}"), "name")


@query()
def balanced_sample(t: Inputs) -> DataFrame:
    """Quotas hold; which rows, a hash decides"""
    p = t(POINTS)
    a = sample.balanced(p, "label", "gid", 5).groupBy("label").agg(F.count("*").alias("n"))
    b = sample.stratified(p, "label", "gid", 3, 40).groupBy("label").agg(F.count("*").alias("m"))
    return a.join(b, "label")


@query()
def farthest_first_codes(t: Inputs) -> DataFrame:
    """Held against plain code in the tests"""
    p = t(POINTS)
    codes = cb.kmeans(p, 12, 6, init=cb.farthest_first(p, 12))
    n = cb.nearest_code(p, codes).groupBy("code_id").agg(F.count("*").alias("n"))
    return codes.join(n, "code_id", "left").select("code_id", F.coalesce("n", F.lit(0)).alias("n"), F.round(norm("vec"), 6).alias("length"))


@query()
def tangent_residual_codes(t: Inputs) -> DataFrame:
    """Levels at right angles, weighed by usage; held against plain code in the tests"""
    p = t(POINTS).withColumn("w", (F.col("gid") % 3 + 1).cast("double"))
    _, ids, rebuilt = cb.residual_spherical(p, [12, 12], 4, "w")
    cos = rebuilt.withColumnRenamed("vec", "r").join(p, "gid").select("gid", F.round(dot("r", "vec") / norm("vec"), 6).alias("cos"))
    return ids.groupBy("gid").agg(F.count("*").alias("levels")).join(cos, "gid")


@query()
def adaptive_codebook(t: Inputs) -> DataFrame:
    """Histogram of ids a point"""
    return cb.adaptive_codebook(t(POINTS).withColumn("cap", F.lit(1)), 24, 4, 4, 0.002, 0.9, "cap")[2]


_EXT = f"WITH p AS ({POINTS}), k AS ({_SLOTS}), c AS ({_CODES}), e AS (SELECT vec_id AS code_id, embedding AS vec FROM {{embeddings}} WHERE vec_id >= 32 AND vec_id < 48), x AS ({vsum('(SELECT gid, weight / 255.0 AS w8, vec FROM k JOIN c USING (code_id))', 'gid', 'w8')}), n AS (SELECT gid, {unit('s')} AS now FROM x), pv AS (SELECT gid, vec::DOUBLE[] AS v FROM p), g AS (SELECT gid, {unit('v')} AS goal FROM pv), r AS (SELECT gid, goal, now, {mix('goal', 'now', '-1')} AS d FROM g JOIN n USING (gid)), a AS (SELECT r.*, code_id, e.vec::DOUBLE[] AS code, list_dot_product(d, e.vec::DOUBLE[]) AS s FROM r, e), b AS (SELECT *, least(greatest(s, 0), 1) AS coef FROM a QUALIFY row_number() OVER (PARTITION BY gid ORDER BY s DESC, code_id) = 1), y AS (SELECT *, {mix('now', 'code', 'coef')} AS new FROM b), z AS (SELECT *, list_dot_product(goal, now) AS oc, list_dot_product(goal, new) / greatest(sqrt(list_dot_product(new, new)), 1e-8) AS nc FROM y)"


@query(_EXT + " SELECT gid, code_id, round(coef, 6) AS coefficient, coef > 1e-6 AND nc - oc >= 0.0001 AS accepted, round(CASE WHEN coef > 1e-6 AND nc - oc >= 0.0001 THEN nc ELSE oc END, 6) AS cosine FROM z")
def residual_extension(t: Inputs) -> DataFrame:
    """C11: one more code a point from a given extension, kept where it gains"""
    ext = t("SELECT vec_id AS code_id, embedding AS vec FROM {embeddings} WHERE vec_id >= 32 AND vec_id < 48").withColumn("vec", as_double("vec"))
    out = cb.extend_codes(t(POINTS), t(_SLOTS), _codes(t), ext, 0.0001)
    return out.select("gid", "code_id", F.round("coefficient", 6).alias("coefficient"), "accepted", F.round("cosine", 6).alias("cosine"))


@query()
def vocabulary_extension(t: Inputs) -> DataFrame:
    """C11: the extension learned from what the slots leave"""
    ext = cb.learn_extension(t(POINTS), t(_SLOTS), _codes(t), 8, 4)
    out = cb.extend_codes(t(POINTS), t(_SLOTS), _codes(t), ext, 0.0001)
    return out.groupBy("code_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"))


_FINE = "SELECT vec_id % 4 AS parent, vec_id AS code_id, embedding AS vec FROM {embeddings} WHERE vec_id < 32"


@query(f"WITH p AS ({POINTS}), f AS ({_FINE}), s AS (SELECT gid, code_id, list_dot_product(p.vec::DOUBLE[], f.vec::DOUBLE[]) AS s FROM p JOIN f ON f.parent = gid % 4), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s DESC, code_id) - 1 AS rank FROM s) SELECT gid, rank::INT AS rank, code_id, round(s, 6) AS score FROM r WHERE rank < 2")
def mounted_codes(t: Inputs) -> DataFrame:
    """The two best fine codes of each point's parent"""
    p = t(POINTS).withColumn("parent", F.col("gid") % 4)
    return cb.mount_codes(p, t(_FINE), 2).select("gid", "rank", "code_id", F.round("score", 6).alias("score"))


@query(f"WITH p AS ({POINTS}), f AS ({_FINE}), s AS (SELECT gid, code_id, list_dot_product(p.vec::DOUBLE[], f.vec::DOUBLE[]) AS s FROM p JOIN f ON f.parent = gid % 4), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s DESC, code_id) AS r FROM s QUALIFY r <= 2) SELECT code_id, sum(gid % 3 + 1)::DOUBLE AS usage, array_to_string(array_agg(gid ORDER BY gid), ',') AS gids FROM r GROUP BY 1")
def reverse_mounts(t: Inputs) -> DataFrame:
    """The reverse mount, with usage"""
    p = t(POINTS).withColumn("parent", F.col("gid") % 4)
    usage = p.select("gid", (F.col("gid") % 3 + 1).cast("double").alias("usage"))
    r = cb.reverse_mounts(cb.mount_codes(p, t(_FINE), 2), usage)
    return r.select("code_id", "usage", F.array_join(F.transform("gids", lambda x: x.cast("string")), ",").alias("gids"))


@query()
def hierarchical_codebook(t: Inputs) -> DataFrame:
    """Held against its definition in the tests"""
    _, book, own = cb.hierarchical_codebook(t(POINTS), 6, 4, 3)
    m = cb.mount_codes(own, book, 1)
    return m.groupBy("code_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("cos")).join(book.select("code_id", "parent"), "code_id")


@query()
def query_bank(t: Inputs) -> DataFrame:
    """A bank of unit queries from as many observations of each label"""
    return cb.query_bank(t(POINTS), "label", 20, 8, 4).select("code_id", F.round(norm("vec"), 6).alias("length"))


@query(f"WITH k AS ({_SLOTS}) SELECT gid, slot, CASE WHEN weight < 70 THEN 65535 ELSE code_id END AS short, CASE WHEN weight < 70 THEN 4294967295 ELSE code_id END AS long FROM k")
def compact_ids(t: Inputs) -> DataFrame:
    """C17"""
    code = F.when(F.col("weight") >= 70, F.col("code_id"))
    return t(_SLOTS).select("gid", "slot", cb.compact_id(code, 32).alias("short"), cb.compact_id(code, 70_000).alias("long"))


@query(f"WITH k AS ({_SLOTS}), c AS ({_CODES}) SELECT (SELECT count(*) FROM {{embeddings}}) AS points, (SELECT count(*) FROM k) * 3 + (SELECT count(*) FROM c) * 64 * 2 AS bytes, round(2.0 * 64 * (SELECT count(*) FROM {{embeddings}}) / ((SELECT count(*) FROM k) * 3 + (SELECT count(*) FROM c) * 64 * 2), 6) AS ratio")
def storage_accounting(t: Inputs) -> DataFrame:
    """Bytes of ids, weights and codes, and the ratio to 16-bit vectors"""
    n, slots, codes = t(POINTS).agg(F.count("*").alias("points")), t(_SLOTS).agg(F.count("*").alias("s")), t(_CODES).agg(F.count("*").alias("c"))
    both = n.join(slots, F.lit(True)).join(codes, F.lit(True))
    size = F.col("s") * 3 + F.col("c") * 64 * 2
    return both.select("points", size.alias("bytes"), F.round(2.0 * 64 * F.col("points") / size, 6).alias("ratio"))
