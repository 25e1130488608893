"""Queries over vectors, distributions and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions import geometry as geo
from pointweave.functions import vec
from pointweave.plans.registry import POINTS, Inputs, query

_PAIRS = "SELECT a.vec_id AS gid, a.embedding AS v, b.embedding AS w, a.label AS label FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1"
_D = "::DOUBLE[]"


@query(f"""WITH p AS ({POINTS}), d AS (SELECT gid, list_transform(vec{_D}, lambda x: x * 3) AS v FROM p)
SELECT gid, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-8), 6) AS first,
  round(list_sum(v) / greatest(sqrt(list_dot_product(v, v)), 1e-8), 5) AS total FROM d""")
def vec_normalize(t: Inputs) -> DataFrame:
    """P1"""
    n = t(POINTS).select("gid", vec.l2_normalize(vec.scale("vec", F.lit(3.0))).alias("n"))
    return n.select("gid", F.round(F.col("n")[0], 6).alias("first"), F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"""WITH p AS ({_PAIRS}), c AS (SELECT gid, list_dot_product(v{_D}, w{_D}) / greatest(sqrt(list_dot_product(v{_D}, v{_D})) * sqrt(list_dot_product(w{_D}, w{_D})), 1e-8) AS c FROM p)
SELECT gid, round(c, 6) AS cos, round(least(greatest(1 - c, 0), 2), 6) AS apart, round(least(greatest((c - 0.1) / 0.9, 0), 1), 6) AS confidence, round(0.5 * least(greatest(c, 0), 1), 6) AS reweighted FROM c""")
def vec_cosine_pairs(t: Inputs) -> DataFrame:
    """P2, P3, P12, P13"""
    c = vec.cosine("v", "w")
    return t(_PAIRS).select("gid", F.round(c, 6).alias("cos"), F.round(vec.disagreement("v", "w"), 6).alias("apart"), F.round(vec.agreement_confidence(c, 0.1), 6).alias("confidence"), F.round(vec.directional_weight(F.lit(0.5), "v", "w"), 6).alias("reweighted"))


@query(f"""WITH p AS ({_PAIRS}), b AS (SELECT gid, list_transform(list_zip(v{_D}, w{_D}), lambda z: 0.75 * z[1] + 0.25 * z[2]) AS m FROM p)
SELECT gid, round(m[2] / greatest(sqrt(list_dot_product(m, m)), 1e-8), 6) AS second, round(sqrt(list_dot_product(m, m)), 6) AS length FROM b""")
def vec_blend(t: Inputs) -> DataFrame:
    """P10, P11"""
    b = t(_PAIRS).select("gid", vec.blend("v", "w", F.lit(0.25)).alias("m"))
    return b.select("gid", F.round(vec.l2_normalize("m")[1], 6).alias("second"), F.round(vec.norm("m"), 6).alias("length"))


_DIST = """SELECT s_suppkey AS k, array_agg(n ORDER BY r) AS p, array_agg(q ORDER BY r) AS q FROM (
  SELECT l_suppkey AS s_suppkey, l_linenumber AS r, sum(l_quantity) AS n, sum(l_extendedprice) AS q FROM {lineitem} GROUP BY 1, 2) x GROUP BY 1"""
_DIST_SPARK = """SELECT k, transform(o, x -> x.n) AS p, transform(o, x -> x.q) AS q FROM (
  SELECT k, array_sort(collect_list(struct(r, n, q))) AS o FROM (
    SELECT l_suppkey AS k, l_linenumber AS r, sum(l_quantity) AS n, sum(l_extendedprice) AS q FROM {lineitem} GROUP BY 1, 2) GROUP BY k)"""


@query(f"""WITH d AS ({_DIST}), e AS (SELECT k, list_transform(p, lambda x: x / list_sum(p)) AS p, list_transform(q, lambda x: x / list_sum(q)) AS q FROM d)
SELECT k, round(list_sum(list_transform(list_zip(p, q), lambda z: CASE WHEN z[1] > 0 AND z[2] > 0 THEN z[1] * ln(z[1] / z[2]) ELSE 0 END)), 8) AS kl,
  round(ln(greatest(1, list_sum(list_transform(list_zip(p, q), lambda z: CASE WHEN z[2] > 0 THEN z[1] * z[1] / z[2] ELSE 0 END)))), 8) AS renyi,
  round(list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (ln(z[1]) - ln(z[2])))) / 2, 8) AS symmetric FROM e""")
def distribution_divergence(t: Inputs) -> DataFrame:
    """P4, P5, P7"""
    d = t(_DIST_SPARK).select("k", vec.distribution("p").alias("p"), vec.distribution("q").alias("q"))
    return d.select("k", F.round(vec.kl("p", "q"), 8).alias("kl"), F.round(vec.renyi2("p", "q"), 8).alias("renyi"), F.round(vec.symmetric_kl("p", "q"), 8).alias("symmetric"))


@query()
def kl_trust_region(t: Inputs) -> DataFrame:
    """Held against a plain bisection in the tests."""
    d = t(_DIST_SPARK).select("k", vec.distribution("p").alias("p"), vec.distribution("q").alias("q"))
    m = d.select("k", "p", "q", vec.kl_trust_region("p", "q", 1e-3).alias("m"))
    return m.select("k", F.round(vec.kl("m", "q"), 8).alias("kl"), F.round(F.col("m")[0], 8).alias("first"))


@query("""SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits,
  round(CASE WHEN count(*) < 2 OR count(*) FILTER (l_returnflag = 'R') IN (0, count(*)) THEN 0 ELSE
    -(count(*) FILTER (l_returnflag = 'R') / count(*) * log2(count(*) FILTER (l_returnflag = 'R') / count(*)) + (1 - count(*) FILTER (l_returnflag = 'R') / count(*)) * log2(1 - count(*) FILTER (l_returnflag = 'R') / count(*))) END, 8) AS entropy
FROM {lineitem} GROUP BY 1""")
def binary_entropy(t: Inputs) -> DataFrame:
    """P8"""
    g = t("SELECT l_suppkey AS k, count(*) AS n, count_if(l_returnflag = 'R') AS hits FROM {lineitem} GROUP BY 1")
    return g.select("k", "n", "hits", F.round(vec.binary_entropy("hits", "n"), 8).alias("entropy"))


@query("SELECT p_partkey AS k, round_even(255 * p_retailprice / greatest(p_size + p_retailprice, 1e-8), 0)::INTEGER AS w, round_even(p_size / 51.0 * 255, 0)::INTEGER AS u8 FROM {part}")
def inverse_distance_weights(t: Inputs) -> DataFrame:
    """P9"""
    return t("SELECT * FROM {part}").select(F.col("p_partkey").alias("k"), vec.inverse_distance_weight(F.col("p_size"), F.col("p_retailprice")).alias("w"), vec.half_even_u8(F.col("p_size") / 51.0).alias("u8"))


@query("""SELECT p_partkey AS k, round(1 / (1 + exp(-(p_size - 25) / 5.0)), 8) AS opacity, round(exp(p_size / 50.0), 8) AS size, round(ln((p_size + 0.5) / 51 / (1 - (p_size + 0.5) / 51)), 8) AS logit,
  round(CASE WHEN p_size < 0 THEN 0 ELSE (0.1 + 0.9 * sin(0.5 * pi() * least(greatest(p_size / 10.0, 0), 1))) * exp(ln(0.01) * (1 - least(p_size / 40.0, 1)) + ln(0.0001) * least(p_size / 40.0, 1)) END, 10) AS rate FROM {part}""")
def activations_and_schedule(t: Inputs) -> DataFrame:
    """P20, P29"""
    s = F.col("p_size")
    return t("SELECT * FROM {part}").select(F.col("p_partkey").alias("k"), F.round(vec.sigmoid((s - 25) / 5.0), 8).alias("opacity"), F.round(F.exp(s / 50.0), 8).alias("size"), F.round(vec.logit((s + 0.5) / 51), 8).alias("logit"), F.round(vec.learning_rate(s, 0.01, 0.0001, 40, 10, 0.1), 10).alias("rate"))


_QUAT = """SELECT vec_id AS gid, CAST(embedding[{0}] AS DOUBLE) + 1.0 AS w, CAST(embedding[{1}] AS DOUBLE) * 2 AS x, CAST(embedding[{2}] AS DOUBLE) * 2 AS y,
  CAST(embedding[{3}] AS DOUBLE) * 2 AS z, 1 + abs(CAST(embedding[{4}] AS DOUBLE)) AS s0, 1 + abs(CAST(embedding[{5}] AS DOUBLE)) AS s1, 1 + abs(CAST(embedding[{6}] AS DOUBLE)) AS s2 FROM {embeddings}"""


def _quat(first: int) -> str:
    return _QUAT.replace("{embeddings}", "{{embeddings}}").format(*range(first, first + 7))


@query(f"""WITH q AS ({_quat(1)}), n AS (SELECT *, sqrt(w::DOUBLE*w + x::DOUBLE*x + y::DOUBLE*y + z::DOUBLE*z) AS l FROM q),
u AS (SELECT gid, w/l AS w, x/l AS x, y/l AS y, z/l AS z, s0::DOUBLE AS s0, s1::DOUBLE AS s1, s2::DOUBLE AS s2 FROM n),
r AS (SELECT *, 1-2*(y*y+z*z) AS r00, 2*(x*y-w*z) AS r01, 2*(x*z+w*y) AS r02, 2*(x*y+w*z) AS r10, 1-2*(x*x+z*z) AS r11, 2*(y*z-w*x) AS r12 FROM u)
SELECT gid, round(r01, 5) AS r01, round(r00*r00*s0*s0+r01*r01*s1*s1+r02*r02*s2*s2, 3) AS cxx, round(r00*r10*s0*s0+r01*r11*s1*s1+r02*r12*s2*s2, 3) AS cxy FROM r""")
def quaternion_covariance(t: Inputs) -> DataFrame:
    """P15"""
    d = t(_quat(0))
    q = F.array(*[F.col(c).cast("double") for c in "wxyz"])
    s = F.array(*[F.col(f"s{i}").cast("double") for i in range(3)])
    cov = geo.covariance(q, s)
    return d.select("gid", F.round(geo.rotation(q)[1], 5).alias("r01"), F.round(cov[0], 3).alias("cxx"), F.round(cov[1], 3).alias("cxy"))


_CAM = "SELECT c_custkey AS view_id, 0.5 + (c_custkey % 10) / 20.0 AS fovx, 0.4 + (c_custkey % 7) / 20.0 AS fovy, 320 + c_custkey % 5 AS width FROM {customer}"


@query(f"""WITH c AS ({_CAM}) SELECT view_id, round(width / (2 * tan(fovx / 2)), 6) AS focal, round(2 * atan(width / (2 * (width / (2 * tan(fovx / 2))))), 6) AS fov,
  round(1 / tan(fovx / 2), 6) AS p00, round(1 / tan(fovy / 2), 6) AS p11, round(-100.0 * 0.01 / (100.0 - 0.01), 8) AS p23 FROM c""")
def camera_matrices(t: Inputs) -> DataFrame:
    """P16"""
    x, y, w = (F.col(c).cast("double") for c in ("fovx", "fovy", "width"))
    f, p = geo.fov_to_focal(x, w), geo.projection(x, y)
    return t(_CAM).select("view_id", F.round(f, 6).alias("focal"), F.round(geo.focal_to_fov(f, w), 6).alias("fov"), F.round(p[0], 6).alias("p00"), F.round(p[5], 6).alias("p11"), F.round(p[11], 8).alias("p23"))


_XYZ = """SELECT p_partkey AS gid, CAST(p_partkey % 41 - 20 AS DOUBLE) / 7 AS x, CAST(p_partkey % 29 - 14 AS DOUBLE) / 6 AS y,
  CAST(p_partkey % 23 AS DOUBLE) / 4 - CAST(0.5 AS DOUBLE) AS z, CAST(p_size AS DOUBLE) / 60 AS s FROM {part}"""


@query(f"""WITH p AS ({_XYZ}) SELECT gid, trunc(x * 200 / z + 160)::BIGINT AS px, trunc(y * 200 / z + 120)::BIGINT AS py FROM p
WHERE z > 0.2 AND x * 200 / z + 160 >= 0 AND x * 200 / z + 160 < 320 AND y * 200 / z + 120 >= 0 AND y * 200 / z + 120 < 240""")
def project_points(t: Inputs) -> DataFrame:
    """P18 (near cull and frustum of P17)"""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    u, v = x * 200.0 / z + 160.0, y * 200.0 / z + 120.0
    rows = t(_XYZ).where((z > 0.2) & (u >= 0) & (u < 320) & (v >= 0) & (v < 240))
    return rows.select("gid", geo.pixel(x, z, F.lit(200.0), F.lit(160.0)).alias("px"), geo.pixel(y, z, F.lit(200.0), F.lit(120.0)).alias("py"))


@query(f"""WITH p AS (SELECT gid, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, s::DOUBLE AS s FROM ({_XYZ}) q WHERE z > 0.2),
h AS (SELECT *, greatest(-1.04, least(1.04, x / z)) * z AS hx, greatest(-0.78, least(0.78, y / z)) * z AS hy FROM p),
j AS (SELECT *, 200 / z AS j00, -200 * hx / (z * z) AS j02, 200 / z AS j11, -200 * hy / (z * z) AS j12 FROM h),
c AS (SELECT gid, s * s * (j00 * j00 + j02 * j02) + 0.3 AS a, s * s * j02 * j12 AS b, s * s * (j11 * j11 + j12 * j12) + 0.3 AS c FROM j)
SELECT gid, round(c / (a * c - b * b), 6) AS conic_a, round(-b / (a * c - b * b), 6) AS conic_b, ceil(3 * sqrt((a + c) / 2 + sqrt(greatest(0.1, (a + c) / 2 * (a + c) / 2 - (a * c - b * b)))))::INTEGER AS radius FROM c WHERE a * c - b * b <> 0""")
def splat_projection(t: Inputs) -> DataFrame:
    """P17"""
    rows = t(_XYZ).select("gid", *(F.col(c).cast("double").alias(c) for c in "xyzs")).where("z > 0.2")
    s2, zero = F.col("s") * F.col("s"), F.lit(0.0)
    sp = geo.splat([F.col(c) for c in "xyz"], [s2, zero, zero, s2, zero, s2], (F.lit(200.0), F.lit(200.0)), (F.lit(0.8), F.lit(0.6)))
    return rows.where(sp["det"] != 0).select("gid", F.round(sp["conic_a"], 6).alias("conic_a"), F.round(sp["conic_b"], 6).alias("conic_b"), sp["radius"].alias("radius"))


_SH = "SELECT vec_id AS gid, embedding AS c FROM {embeddings}"


@query(f"""WITH e AS (SELECT gid, c{_D} AS c FROM ({_SH}) q), d AS (SELECT gid, c, c[20] AS x, c[21] AS y, c[22] AS z FROM e)
SELECT gid, round(0.28209479177387814 * c[1] - 0.4886025119029199 * y * c[2] + 0.4886025119029199 * z * c[3] - 0.4886025119029199 * x * c[4]
 + 1.0925484305920792 * x * y * c[5] - 1.0925484305920792 * y * z * c[6] + 0.31539156525252005 * (2 * z * z - x * x - y * y) * c[7] - 1.0925484305920792 * x * z * c[8] + 0.5462742152960396 * (x * x - y * y) * c[9], 7) AS colour,
 round(least(greatest(c[1] * 0.28209479177387814 + 0.5, 0), 1), 7) AS rgb FROM d""")
def sh_colour(t: Inputs) -> DataFrame:
    """P19"""
    d = t(_SH).select("gid", vec.as_double("c").alias("c"))
    return d.select("gid", F.round(geo.sh(2, F.col("c"), [F.col("c")[19], F.col("c")[20], F.col("c")[21]]), 7).alias("colour"), F.round(geo.sh_to_rgb(F.col("c")[0]), 7).alias("rgb"))


@query("""SELECT p_partkey AS k, ((abs(p_size - 30) <= 20 AND NOT abs(p_size - 0) <= 20) OR (abs(p_size + 60 - 150) <= 20 AND NOT abs(p_size + 60 - 400) <= 20)) AS edge, p_size + 60 - p_size AS w FROM {part}""")
def box_near_crop_edge(t: Inputs) -> DataFrame:
    """P21"""
    s = F.col("p_size")
    zero = F.lit(1000)
    edge = geo.near_crop_edge([s, zero, s + 60, zero], [F.lit(30), F.lit(0), F.lit(150), F.lit(0)], [F.lit(0), F.lit(0), F.lit(400), F.lit(0)])
    return t("SELECT * FROM {part}").select(F.col("p_partkey").alias("k"), edge.alias("edge"), (s + 60 - s).alias("w"))


@query("""SELECT l_suppkey AS mask, count(*) FILTER (l_discount > 0.06) AS inner_n, round(count(*) FILTER (l_discount > 0.06) / greatest(count(*) FILTER (l_discount > 0.04), 1), 8) AS stability
FROM {lineitem} GROUP BY 1 HAVING count(*) FILTER (l_discount > 0.06) / greatest(count(*) FILTER (l_discount > 0.04), 1) >= 0.5""")
def mask_quality(t: Inputs) -> DataFrame:
    """P23, P25"""
    g = t("SELECT l_suppkey AS mask, count_if(l_discount > 0.06) AS inner_n, count_if(l_discount > 0.04) AS outer_n FROM {lineitem} GROUP BY 1")
    s = F.col("inner_n") / F.greatest("outer_n", F.lit(1))
    return g.where(s >= 0.5).select("mask", "inner_n", F.round(s, 8).alias("stability"))


@query("SELECT i, round((i % 32 + 0.5) / 32, 8) AS x, round((i // 32 + 0.5) / 32, 8) AS y FROM range(1024) r(i)")
def mask_point_grid(t: Inputs) -> DataFrame:
    """P24"""
    return geo.point_grid(t.spark, 32).select("i", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query("""WITH v AS (SELECT p_partkey AS k, p_retailprice AS x FROM {part}), s AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
n AS (SELECT k, floor(least(greatest((x - lo) / greatest(hi - lo, 1e-8), 0), 1) * 255)::INTEGER AS c FROM v, s) SELECT k, c, 255 - c AS inverse FROM n""")
def colour_map(t: Inputs) -> DataFrame:
    """P27 (index into the colour table; P28's 8-bit step)"""
    v = t("SELECT p_partkey AS k, p_retailprice AS x FROM {part}")
    s = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    n = v.join(F.broadcast(s), F.lit(True)).select("k", F.floor(vec.clip((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)), 0.0, 1.0) * 255).cast("int").alias("c"))
    return n.select("k", "c", (255 - F.col("c")).alias("inverse"))


