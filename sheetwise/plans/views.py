"""Views of the given tables as drawing records, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T

#: Type names that rows are given in turn: those of the fixed tables, and one that none has.
NAMES = list(dict.fromkeys([name for name, _, _ in T.RULES] + T.IMPLEMENTED + ["unmapped"]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, seq, op, a, k, dx, dy."""
    k = F.regexp_extract("props", r'"k":\s*(-?[0-9]+)', 1).try_cast("long")
    op = F.when((F.col("event_type") == "view") & (k % 25 == 0), "reset_state")
    for name, to in (("signup", "set_origin"), ("view", "save_state"), ("error", "restore_state"), ("purchase", "set_attr"), ("click", "rel_point")):
        op = op.when(F.col("event_type") == name, to)
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("drawing_id"), seq.alias("seq"), op.alias("op"), F.round(F.col("value") * 100).cast("long").alias("a"), k.alias("k"))
    return e.select("*", (F.col("a") % 201 - 100).alias("dx"), (F.expr("a div 201") % 201 - 100).alias("dy"))


def v_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, type, size (hundredths)."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.round(F.col("value") * 100).cast("long").alias("size"))


def v_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, shape_id, pt, x, y."""
    at = lambda i: F.round(F.get("embedding", i).cast("double") * 10000).cast("long")
    p = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))).alias("pt", "p")
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("drawing_id"), F.col("vec_id").alias("shape_id"), p).select("drawing_id", "shape_id", F.col("pt").cast("long").alias("pt"), "p.x", "p.y")


def v_unwrapped(x, pt):
    """x of a shape's last point without the turn around 32 bits that a query gave it."""
    return F.when(pt == 31, x - 2**32).otherwise(x)


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, ordinal, time, ok, bytes (hundredths)."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_shipdate").alias("time"), (F.col("l_returnflag") != "R").alias("ok"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"))


def v_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim"), F.col("p_brand").alias("subject"), F.col("p_type").alias("claim_type"), F.col("p_name").alias("statement"), F.lit("active").alias("status"))


def v_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, width, height (whole points)."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.abs(F.round("c_acctbal").cast("long")).alias("width"), (F.col("c_custkey") % 900 + 100).alias("height"), F.col("c_nationkey").cast("long").alias("nation"))


def v_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_types with type taken from NAMES by size."""
    return v_types(spark, sf_dir).withColumn("type", F.get(F.array(*map(F.lit, NAMES)), (F.col("size") % len(NAMES)).cast("int")))


def v_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, shape_id, p: the points (pt, x, y) of each shape in order."""
    return v_pts(spark, sf_dir).groupBy("drawing_id", "shape_id").agg(F.sort_array(F.collect_list(F.struct("pt", "x", "y"))).alias("p"))


#: Commands of a path's points in turn, after the first.
TURNS = "m l H v L h".split()


def v_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, shape_id, data: path texts from all points of each shape, closed."""
    cmd = lambda p: F.when(p["pt"] == 0, "M").otherwise(F.get(F.array(*map(F.lit, TURNS)), (p["pt"] % 6).cast("int")))
    x, y = (lambda p: p["x"].cast("string")), (lambda p: p["y"].cast("string"))
    args = lambda p: F.when(F.upper(cmd(p)) == "H", x(p)).when(F.upper(cmd(p)) == "V", y(p)).otherwise(F.concat(x(p), F.lit(","), y(p)))
    text = F.array_join(F.transform("p", lambda p: F.concat_ws(" ", cmd(p), args(p))), " ")
    return v_shapes(spark, sf_dir).select("drawing_id", "shape_id", F.concat(text, F.lit(" Z")).alias("data"))


def v_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, shape_id, text: a content stream of each shape, a point and an operator a line."""
    token = lambda p: F.get(F.array(*map(F.lit, T.TOKENS.values())), F.pmod(p["x"] + p["y"], F.lit(len(T.TOKENS))).cast("int"))
    text = F.array_join(F.transform("p", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), token(p))), "\n")
    return v_shapes(spark, sf_dir).select("drawing_id", "shape_id", text.alias("text"))


OPS_SQL = """v_ops AS (SELECT drawing_id, seq, op, a, k, a % 201 - 100 AS dx, (a // 201) % 201 - 100 AS dy FROM (
  SELECT user_id AS drawing_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE WHEN event_type = 'view' AND TRY_CAST(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS BIGINT) % 25 = 0 THEN 'reset_state'
      WHEN event_type = 'signup' THEN 'set_origin' WHEN event_type = 'view' THEN 'save_state' WHEN event_type = 'error' THEN 'restore_state'
      WHEN event_type = 'purchase' THEN 'set_attr' WHEN event_type = 'click' THEN 'rel_point' END AS op,
    CAST(round(value * 100) AS BIGINT) AS a, TRY_CAST(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS BIGINT) AS k FROM events))"""
TYPES_SQL = "v_types AS (SELECT user_id AS file, event_id AS seq, event_type AS type, CAST(round(value * 100) AS BIGINT) AS size FROM events)"
PTS_SQL = """v_pts AS (SELECT CAST(label AS BIGINT) AS drawing_id, vec_id AS shape_id, i AS pt,
  CAST(round(CAST(embedding[2 * i + 1] AS DOUBLE) * 10000) AS BIGINT) AS x, CAST(round(CAST(embedding[2 * i + 2] AS DOUBLE) * 10000) AS BIGINT) AS y
  FROM embeddings, (SELECT unnest(range(32)) AS i))"""
RUNS_SQL = "v_runs AS (SELECT l_orderkey AS run, CAST(l_linenumber AS BIGINT) AS ordinal, l_shipdate AS time, l_returnflag <> 'R' AS ok, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes FROM lineitem)"
CLAIMS_SQL = "v_claims AS (SELECT p_partkey AS claim, p_brand AS subject, p_type AS claim_type, p_name AS statement, 'active' AS status FROM part)"
DIMS_SQL = "v_dims AS (SELECT c_custkey AS id, abs(CAST(round(c_acctbal) AS BIGINT)) AS width, c_custkey % 900 + 100 AS height, CAST(c_nationkey AS BIGINT) AS nation FROM customer)"
NAMES_SQL = TYPES_SQL + f""", v_names AS (SELECT file, seq, size, [{', '.join(f"'{n}'" for n in NAMES)}][size % {len(NAMES)} + 1] AS type FROM v_types)"""
PATHS_SQL = PTS_SQL + f""", v_cmds AS (SELECT *, CASE WHEN pt = 0 THEN 'M' ELSE [{', '.join(f"'{c}'" for c in TURNS)}][pt % 6 + 1] END AS cmd FROM v_pts)"""
CONTENT_SQL = PTS_SQL + f""", v_content AS (SELECT drawing_id, shape_id, string_agg(x || ' ' || y || ' ' || [{', '.join(f"'{t}'" for t in T.TOKENS.values())}][((x + y) % {len(T.TOKENS)} + {len(T.TOKENS)}) % {len(T.TOKENS)} + 1], chr(10) ORDER BY pt) AS text FROM v_pts GROUP BY ALL)"""
