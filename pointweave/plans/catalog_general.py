"""Strings, JSON, arrays, windows of time, set operations and plain relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions import plug
from pointweave.functions.vec import squared_distance
from pointweave.operators import evaluate as ev
from pointweave.plans.registry import CONTRIBS, Inputs, query
from pointweave.sources.readers import label_polygons
from pointweave.streaming import windows as win


@query("SELECT page_id, trim(split_part(url, '/', 3)) AS host, regexp_extract(url, '([^/.]+)[^/]*$', 1) AS stem, lpad(page_id::VARCHAR, 5, '0') AS frame, starts_with(url, 'https') AS secure, replace(url, '/', '_') AS flat FROM {pages}")
def string_functions(t: Inputs) -> DataFrame:
    """F1"""
    u = F.col("url")
    return t("SELECT * FROM {pages}").select("page_id", F.trim(F.split_part(u, F.lit("/"), F.lit(3))).alias("host"), F.regexp_extract(u, r"([^/.]+)[^/]*$", 1).alias("stem"), F.lpad(F.col("page_id").cast("string"), 5, "0").alias("frame"), u.startswith("https").alias("secure"), F.replace(u, F.lit("/"), F.lit("_")).alias("flat"))


@query("SELECT s_name AS concept, replace(p, '%s', s_name) AS prompt FROM {supplier}, (SELECT unnest(['a photo of %s', '%s in a scene']) AS p)")
def prompt_templates(t: Inputs) -> DataFrame:
    """F2"""
    return plug.prompts(t("SELECT s_name AS concept FROM {supplier}"), ["a photo of %s", "%s in a scene"])


_LABEL = "'{{\"info\":{{\"name\":\"' || p_name || '\",\"width\":64,\"height\":48}},\"objects\":[{{\"category\":\" ' || p_type || ' \",\"segmentation\":[[1,2],[' || (10 + p_size % 9) || ',2],[9,' || (12 + p_size % 7) || ']]}},{{\"category\":\" \",\"segmentation\":[[0,0],[1,1],[2,2]]}},{{\"category\":\"line\",\"segmentation\":[[0,0],[1,1]]}}]}}'"


@query("SELECT p_name AS image, trim(p_type) AS category, 3 AS corners, (10 + p_size % 9)::DOUBLE AS x1, (12 + p_size % 7)::DOUBLE AS y2 FROM {part}")
def label_json_explode(t: Inputs) -> DataFrame:
    """S15, F3, D17"""
    docs = t(f"SELECT {_LABEL} AS value FROM {{part}}")
    return label_polygons(docs).select("image", "category", F.size("points").alias("corners"), F.col("points")[1]["x"].alias("x1"), F.col("points")[2]["y"].alias("y2"))


@query("""WITH p AS (SELECT p_partkey AS image, 10 + p_size % 9 AS w, 12 + p_size % 7 AS h FROM {part}), g AS (SELECT unnest(range(0, 64)) AS px), k AS (SELECT unnest(range(0, 48)) AS py)
SELECT image, count(*) AS pixels, min(px) AS left, max(py) AS low FROM p, g, k WHERE py + 0.5 > 2 AND py + 0.5 < h AND px + 0.5 >= 2 AND px + 0.5 < 2 + w * 1.0 * (h - (py + 0.5)) / (h - 2) GROUP BY 1""")
def polygon_raster(t: Inputs) -> DataFrame:
    """Right triangles, whose runs SQL can state"""
    p = t("SELECT p_partkey AS image, 10 + p_size % 9 AS w, 12 + p_size % 7 AS h FROM {part}")
    d = lambda c: F.lit(c).cast("double") if isinstance(c, int) else c.cast("double")
    corner = lambda x, y: F.struct(d(x).alias("x"), d(y).alias("y"))
    tri = p.select("image", F.lit(0).alias("poly"), F.array(corner(2, 2), corner(F.col("w") + 2, 2), corner(2, F.col("h"))).alias("points"))
    return ev.rasterise(tri, ["image"], 48, 64).groupBy("image").agg(F.count("*").alias("pixels"), F.min("px").cast("long").alias("left"), F.max("py").cast("long").alias("low"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM {events}")
def event_json(t: Inputs) -> DataFrame:
    """F3"""
    e = t("SELECT event_id, event_type, from_json(props, 'map<string,string>') AS m, json_object_keys(props) AS k FROM {events}")
    return e.select("event_id", "event_type", F.col("m")[F.col("k")[0]].alias("first"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY ALL")
def window_counts(t: Inputs) -> DataFrame:
    """T3 (tumbling)"""
    w = win.tumbling(t("SELECT * FROM {events}"), "1 hour", "10 minutes", ["event_type"], "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH s AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, event_id FROM {events}, (SELECT unnest([0, 1]) AS k)) SELECT start, count(*) AS n FROM s GROUP BY 1")
def sliding_counts(t: Inputs) -> DataFrame:
    """T3 (sliding)"""
    w = win.sliding(t("SELECT * FROM {events}"), "2 hours", "1 hour", "10 minutes", [], "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM {events}), g AS (SELECT user_id, ts, sum((b IS NULL OR ts >= b + INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def session_counts(t: Inputs) -> DataFrame:
    """T3 (sessions)"""
    w = win.sessions(t("SELECT * FROM {events}"), "6 hours", "10 minutes", ["user_id"], "value")
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH c AS ({CONTRIBS}) SELECT gid, round(sum(weight), 4) AS w, round(sum(weight * tax), 6) AS s FROM c GROUP BY 1")
def incremental_consensus(t: Inputs) -> DataFrame:
    """Three micro-batches merged equal one pass"""
    c = t(CONTRIBS).withColumnRenamed("tax", "value")
    state = None
    for i in range(3):
        state = win.merge_into(win.incremental_consensus(c.where(F.col("view_id") % 3 == i)), state)
    return state.select("gid", F.round("w", 4).alias("w"), F.round("s", 6).alias("s"))


@query("SELECT l_suppkey AS k, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS lines, count(*) AS n, sum(l_linenumber)::BIGINT AS last FROM {lineitem} GROUP BY 1")
def array_idioms(t: Inputs) -> DataFrame:
    """F5, P31"""
    r = t("SELECT l_suppkey AS k, l_linenumber AS l FROM {lineitem}").groupBy("k").agg(F.array_sort(F.collect_set("l")).alias("s"), F.count("*").alias("n"), F.sum("l").alias("last"))
    return r.select("k", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("lines"), "n", "last")


@query("SELECT c_custkey AS k, printf('%.2f%%', 100 * abs(c_acctbal) / 9973) AS percent FROM {customer}")
def percent_format(t: Inputs) -> DataFrame:
    """F4, E12"""
    return t("SELECT * FROM {customer}").select(F.col("c_custkey").alias("k"), F.format_string("%.2f%%", 100 * F.abs("c_acctbal") / 9973).alias("percent"))


@query("SELECT c_custkey AS k FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000) EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'")
def semi_and_anti(t: Inputs) -> DataFrame:
    """J20, J22, U1, U6"""
    c, o = t("SELECT c_custkey AS k FROM {customer}"), t("SELECT o_custkey AS k, o_totalprice, o_orderstatus FROM {orders}")
    return c.join(o.where("o_totalprice > 400000"), "k", "left_semi").join(o.where("o_orderstatus = 'P'"), "k", "left_anti")


@query("SELECT r_name AS coarse, n_name AS fine, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)")
def hierarchy_cube(t: Inputs) -> DataFrame:
    """Fine to coarse roll-up"""
    rows = t("SELECT r_name AS coarse, n_name AS fine, s_acctbal FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey")
    return rows.cube("coarse", "fine").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM {lineitem} GROUP BY ALL")
def pricing_summary(t: Inputs) -> DataFrame:
    """A plain aggregate over the contribution fact"""
    d = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t("SELECT * FROM {lineitem}").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(d), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT a.vec_id AS gid, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d2 FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 7")
def lagged_distance(t: Inputs) -> DataFrame:
    """A self-join on an offset key"""
    return t("SELECT a.vec_id AS gid, a.embedding AS v, b.embedding AS w FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 7").select("gid", F.round(squared_distance("v", "w"), 6).alias("d2"))


@query()
def linear_codec(t: Inputs) -> DataFrame:
    """What eight leading directions keep"""
    p = t("SELECT vec_id AS gid, embedding AS vec FROM {embeddings}")
    coded = plug.LinearCodec.fit(p, 8).encode(p)
    return coded.select("gid", F.round(F.aggregate("code", F.lit(0.0), lambda a, x: a + x * x), 5).alias("kept"))
