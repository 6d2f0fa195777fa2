"""Type distributions, coverage, samples and set operations over op records (file, seq, type, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from .joins import small

#: Words in a type name that mark geometry. Fixed values.
GEOMETRY_WORDS = "polytriangle|polyline|line|polygon|circle|ellipse|bezier|rectangle|contour"


def unify_fields(ops: DataFrame, synonyms: dict[str, list[str]], default_type: str = "unknown") -> DataFrame:
    """One spelling for each field: the first of its synonyms that is set. A missing type becomes default_type."""
    unified = {k: F.coalesce(*map(F.col, v)) for k, v in synonyms.items()}
    if "type" in unified:
        unified["type"] = F.coalesce(unified["type"], F.lit(default_type))
    drop = {c for v in synonyms.values() for c in v} - set(unified)
    return ops.select(*[c for c in ops.columns if c not in drop and c not in unified], *[v.alias(k) for k, v in unified.items()])


def rules_table(spark: SparkSession) -> DataFrame:
    """The fixed categories as rules (type, category, priority)."""
    return spark.createDataFrame(T.RULES, "type string, category string, priority int")


def implemented_table(spark: SparkSession) -> DataFrame:
    """The types that are implemented."""
    return spark.createDataFrame([(x,) for x in T.IMPLEMENTED], "type string")


def classify(ops: DataFrame, rules: DataFrame | None = None, default: str = T.DEFAULT_CATEGORY) -> DataFrame:
    """ops with category: that of the rule (type, category, priority) of least priority for its type; the fixed categories without rules."""
    rules = rules_table(ops.sparkSession) if rules is None else rules
    best = rules.groupBy("type").agg(F.min_by("category", "priority").alias("category"))
    return ops.join(small(best), "type", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def is_geometry(kind: Column, mode: str = "words", types: list[str] | None = None) -> Column:
    """Whether a type is geometry, by the words in its name or by an exact list."""
    return kind.rlike(f"(?i)({GEOMETRY_WORDS})") if mode == "words" else kind.isin(types or [])


def problems(ops: DataFrame) -> DataFrame:
    """Unknown and error records."""
    return ops.where(F.col("type").startswith("unknown") | (F.col("type") == "error"))


def until_end(ops: DataFrame, is_end: Column) -> DataFrame:
    """Each drawing's records up to its first end marker, which stays. Records without a place (seq null) all stay, and a marker among them ends nothing."""
    first = ops.where(is_end).groupBy(F.col("drawing_id").alias("_drawing")).agg(F.min("seq").alias("_end"))
    kept = ops.join(first, ops["drawing_id"].eqNullSafe(first["_drawing"]), "left")
    return kept.where(F.col("_end").isNull() | F.col("seq").isNull() | (F.col("seq") <= F.col("_end"))).drop("_drawing", "_end")


def split_valid(ops: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): records that break no rule, and the others with the messages of those they break."""
    checked = ops.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(m)) for m, bad in rules.items()])))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def type_counts(ops: DataFrame, by: str = "type") -> DataFrame:
    """Count and percent of each type in its file."""
    n = ops.groupBy("file", by).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy("file")))


def problem_groups(ops: DataFrame) -> DataFrame:
    """Problems by type and code: their number and the first one's message."""
    return problems(ops).groupBy("type", "code").agg(F.count("*").alias("n"), F.min_by("message", F.struct("file", "seq")).alias("sample"))


def compare_files(ops: DataFrame, files: list) -> DataFrame:
    """A row for each type, a column of counts for each of the named files; null where a file has none."""
    return ops.where(F.col("file").isin(files)).groupBy("type").pivot("file", files).agg(F.count(F.lit(1)))


def coverage(ops: DataFrame, impl: list[str]) -> DataFrame:
    """(file, total, covered, percent) for each file, and for all with file null."""
    hit = F.count_if(F.col("type").isin(impl))
    return ops.rollup("file").agg(F.count("*").alias("total"), hit.alias("covered"), F.coalesce(F.try_divide(100 * hit, F.count("*")), F.lit(0.0)).alias("percent"))


def covered(ops: DataFrame, impl: DataFrame) -> DataFrame:
    """Records whose type is implemented."""
    return ops.join(small(impl), "type", "left_semi")


def missing(ops: DataFrame, impl: DataFrame, above: int = 0) -> DataFrame:
    """Types not implemented, with category and occurrences, where there are more than above."""
    return ops.join(small(impl), "type", "left_anti").groupBy("category", "type").agg(F.count("*").alias("n")).where(F.col("n") > above)


def unique_to_file(ops: DataFrame) -> DataFrame:
    """(type, file) of types that one file alone has. Two extremes tell as much as a distinct count, and combine before the shuffle."""
    return ops.groupBy("type").agg(F.min("file").alias("file"), F.max("file").alias("_last")).where("file = _last").drop("_last")


def ops_per_mb(ops: DataFrame, files: DataFrame, geometry: Column) -> DataFrame:
    """Geometry records for each MB of a file; 0 where the size is 0."""
    n = ops.groupBy("file").agg(F.count_if(geometry).alias("n"))
    return n.join(files, "file").select("file", "n", F.coalesce(F.try_divide("n", F.col("bytes") / 1048576), F.lit(0.0)).alias("per_mb"))


def rollup_counts(ops: DataFrame) -> DataFrame:
    """Counts by file and type, by file, and of all; level is 0, 1 and 3."""
    return ops.rollup("file", "type").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def rank_types(ops: DataFrame, n: int = 50) -> DataFrame:
    """The n most frequent types of each file, with rank and percent; ties by name."""
    rank = F.row_number().over(W.partitionBy("file").orderBy(F.desc("n"), "type"))
    return type_counts(ops).withColumn("rank", rank).where(F.col("rank") <= n)


def top_types(ops: DataFrame, k: int) -> DataFrame:
    """The k most frequent types of all files."""
    return ops.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(k)


def sample_first(ops: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first n records of each group of keys."""
    return ops.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("seq"))).where(F.col("_r") <= n).drop("_r")


def cap_ops(ops: DataFrame, n: int = 1000) -> DataFrame:
    """At most n records of each drawing, the first ones."""
    return sample_first(ops, n, ["drawing_id"])


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """A listing in the order of keys."""
    return df.orderBy(*keys)


def head_list(items: Column, n: int) -> Column:
    """The first n entries of a list, or characters of a text given as such a list."""
    return F.slice(items, 1, n)


def union_ops(streams: list[DataFrame]) -> DataFrame:
    """All records of the streams in order: stream, then seq. Columns that a stream lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)])


def all_types(streams: list[DataFrame]) -> DataFrame:
    """The types that any stream has."""
    return reduce(DataFrame.union, [s.select("type").distinct() for s in streams]).distinct()


def shared_types(a: DataFrame, b: DataFrame) -> DataFrame:
    """The types that both have."""
    return a.select("type").intersect(b.select("type"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """The types of a that b lacks."""
    return a.select("type").subtract(b.select("type"))
