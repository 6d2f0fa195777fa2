"""Package members, batch ledgers, claims and guarded per-record jobs."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from .joins import small

#: Planned steps with and without preprocessing. Fixed values.
PREPROCESSED = ["Extract W2D binary files", "Parse W2D opcodes", "Generate XPS XML pages", "Create DWFX archive", "Extract XPS pages", "Parse XPS XML", "Generate PDF"]
DIRECT = ["Extract XPS pages directly", "Parse XPS XML", "Generate PDF"]
#: Claims of a side in a block of pairs, at least and at most, and the share of all pairs that a block in between may hold.
SIDE, MOST_SIDE, BLOCKS = 2048, 65_536, 128
#: Claims in a list as it is met and, about, as it is collected; pairs of a task, and the most tasks.
PIECE, MOST_LIST, PAIRS, MOST_TASKS = 128, 1 << 20, 1 << 20, 2000
IMAGES = ["png", "jpg", "jpeg", "tif", "tiff", "gif", "bmp"]


def route(members: DataFrame, is_stream: Column, is_page: Column) -> DataFrame:
    """(file, member) -> file, format, needs_preprocessing, plan. Both kinds are Mixed, and pages win."""
    m = members.groupBy("file").agg(F.bool_or(is_stream).alias("streams"), F.bool_or(is_page).alias("pages"))
    kind = F.when(F.col("streams") & F.col("pages"), "Mixed").when(F.col("pages"), "XPS").when(F.col("streams"), "W2D").otherwise("Unknown")
    steps = lambda x: F.array(*map(F.lit, x))
    plan = F.when(F.col("streams") & ~F.col("pages"), steps(PREPROCESSED)).otherwise(steps(DIRECT))
    return m.select("file", kind.alias("format"), (F.col("streams") & ~F.col("pages")).alias("needs_preprocessing"), plan.alias("plan"))


def member_profile(members: DataFrame) -> DataFrame:
    """(file, suffix, bytes) -> a row for each file and suffix: members, bytes and the images' share of the file's bytes."""
    per = members.groupBy("file", "suffix").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    w = W.partitionBy("file")
    images = F.sum(F.when(F.col("suffix").isin(IMAGES), F.col("bytes")).otherwise(0)).over(w)
    return per.withColumn("image_share", F.coalesce(F.try_divide(images, F.sum("bytes").over(w)), F.lit(0.0)))


def token_patterns(mode: str = "space") -> dict[str, str]:
    """Patterns of the fixed content operators: after any space and before one or the end, or after a blank and before a blank or line end."""
    after, before = {"space": (r"[ \t\n\x0B\f\r]", r"(?:[ \t\n\x0B\f\r]|$)"), "literal": (" ", r"[ \n]")}[mode]
    return {name: f"{after}{t}{before}" for name, t in T.TOKENS.items()}


def token_counts(docs: DataFrame, tokens: dict[str, str], totals: dict[str, list[str]]) -> DataFrame:
    """How often each token's pattern matches in text, and the sums of named tokens."""
    out = docs.select("*", *[F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias(k) for k, p in tokens.items()])
    return out.select("*", *[sum(map(F.col, v[1:]), F.col(v[0])).alias(k) for k, v in totals.items()]).drop("text")


def content_labels(paths: Column, texts: Column, fills: Column, strokes: Column) -> Column:
    """The labels of complexity (none up to 10 paths), of text and of balance. The texts and limits are fixed values."""
    tier = (
        F.when(paths > 1000, "Technical Drawing (High complexity)").when(paths > 100, "Technical Drawing (Medium complexity)").when(paths > 10, "Simple Diagram")
    )
    text = F.when(texts > 100, "Contains significant text").when(texts > 0, "Contains some text").otherwise("Minimal or no text")
    balance = F.when(fills > strokes * 2, "Predominantly filled shapes").when(strokes > fills * 2, "Predominantly line drawings").otherwise("Mix of fills and strokes")
    return F.coalesce(F.array_compact(F.array(tier, text, balance)), F.array(F.lit("Unknown")))


def batch_summary(runs: DataFrame) -> DataFrame:
    """(batch, input, ok) -> batch, total, succeeded, failed, statuses in the order of input."""
    status = F.struct("input", F.when(F.col("ok"), "success").otherwise("failed").alias("status"))
    return runs.groupBy("batch").agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sort_array(F.collect_list(status)).alias("statuses"))


def run_durations(steps: DataFrame) -> DataFrame:
    """(run, ordinal, time) with elapsed, milliseconds since the step before, and run_ms, those of the whole run."""
    ms = F.unix_millis(F.col("time"))
    w = W.partitionBy("run")
    return steps.select("*", (ms - F.lag(ms).over(w.orderBy("ordinal", "time"))).alias("elapsed"), (F.max(ms).over(w) - F.min(ms).over(w)).alias("run_ms"))


def image_totals(objects: DataFrame, is_image: Column) -> DataFrame:
    """Number and bytes of the images of each file."""
    return objects.where(is_image).groupBy("file").agg(F.count("*").alias("images"), F.sum("bytes").alias("bytes"))


def contradictions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs of claims (claim, subject, claim_type, statement) on the same subject and type that state different things.

    subject may be an array subjects; then the claims' subjects must overlap, and the shared ones are returned as overlap.

    There are as many pairs as there are contradictions, which for a crowded subject and type grow with the square of its claims. What is shuffled does not: claims
    of equal subjects, type and statement go as one row (lists of PIECE claims at most), and a crowded key is cut into blocks that hold about one in BLOCKS of all pairs, so
    that claims are sent some twelve times each at most, unless blocks would pass MOST_SIDE claims a side. Lists are met, and what they share is found, once for all their pairs;
    the pairs come last, list by list, and are never shuffled. A claim with subjects meets another at each that they share; the pair is made at the least of them alone.
    """
    keys, sides = ["subject", "claim_type"], []
    listed = "subjects" in new.columns
    for x in (new, old):
        x = x.where("claim_type is not null and statement is not null")
        if listed:
            x = _merged(x.select("claim", "claim_type", "statement", F.sort_array(F.array_distinct(F.array_compact("subjects"))).alias("subjects")))
        sides.append(x.where("size(subjects) > 0" if listed else "subject is not null"))
    n, o = ((x.withColumn("subject", F.explode("subjects")) if listed else x).groupBy(*keys).agg(F.count("*").alias(k)) for x, k in zip(sides, ("_n", "_o")))
    blocks = n.join(o, keys)
    sums = [F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("_n").cast("double") * F.col("_o"), F.col("_n").cast("double") + F.col("_o"))]
    pairs, claims, *most = blocks.agg(*sums, *[F.coalesce(F.max(k), F.lit(1)) for k in ("_n", "_o")]).first()
    side = max(SIDE, min(MOST_SIDE, math.sqrt(pairs / BLOCKS)))
    blocks = small(blocks.select(*keys, *[F.ceil(F.col(k) / side).alias(k) for k in ("_n", "_o")]))
    tasks = max(1, min(MOST_TASKS, math.ceil(pairs / PAIRS + claims / MOST_SIDE)))
    more = ["before", "after"] if listed else []

    def dealt(x: DataFrame, name: str, own: str, other: str, crowd: int) -> DataFrame:
        # Sorted, so that a task that runs again cuts the same lists. collect_list leaves nulls out.
        claims = F.concat(F.sort_array(F.collect_list("claim")), F.array_repeat(F.lit(None).cast(x.schema["claim"].dataType), F.count_if(F.col("claim").isNull()).cast("int")))
        part = F.pmod(F.xxhash64("claim", "statement"), F.lit(math.ceil(crowd / MOST_LIST)))
        x = x.groupBy("claim_type", "statement", "subjects" if listed else "subject", part.alias("part")).agg(claims.alias("claims"))
        if listed:
            x = x.select("*", F.posexplode("subjects").alias("at", "subject")).withColumns({"before": F.expr("slice(subjects, 1, at)"), "after": F.expr("slice(subjects, at + 2, size(subjects))")})
        x = x.join(blocks, keys).withColumn("claims", F.explode(F.expr(f"transform(sequence(0, (size(claims) - 1) div {PIECE}), k -> slice(claims, int(k * {PIECE} + 1), {PIECE}))")))
        x = x.withColumn(own, F.pmod(F.xxhash64(F.get("claims", F.lit(0)), "statement"), F.col(own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return x.repartition(tasks, *keys, "_n", "_o").select(*keys, "_n", "_o", *[F.col(c).alias(f"{name}_{c}") for c in ("claims", "statement", *more)])

    both = dealt(sides[0], "new", "_n", "_o", most[0]).join(dealt(sides[1], "old", "_o", "_n", most[1]).hint("merge"), [*keys, "_n", "_o"]).where("new_statement <> old_statement")
    if listed:
        # A hash set for each pair of lists is dear, and a single subject needs none.
        single = lambda k: F.size(f"new_{k}") <= 1
        held = lambda k: F.coalesce(F.array_contains(f"old_{k}", F.get(f"new_{k}", F.lit(0))), F.lit(False))
        seen = F.when(single("before"), held("before")).otherwise(F.arrays_overlap("new_before", "old_before"))
        rest = F.when(single("after") & ~held("after"), F.slice("new_after", 1, 0)).when(single("after"), F.col("new_after")).otherwise(F.array_intersect("new_after", "old_after"))
        both = both.where(~seen).withColumn("overlap", F.concat(F.array("subject"), rest))
    told = ["claim_type", "new_statement", "old_statement", "overlap" if listed else "subject"]
    # Generated code holds all rows that a row explodes to; a lambda keeps this step out of it, which then gives one claim at a time.
    both = both.select(*told, "old_claims", F.explode(F.transform("new_claims", lambda c: c)).alias("new_claim"))
    both = both.select(*told, "new_claim", F.explode("old_claims").alias("old_claim"))
    return both.select("new_claim", "old_claim", *told) if listed else both.select(*keys, "new_claim", "new_statement", "old_claim", "old_statement")


def _merged(claims: DataFrame) -> DataFrame:
    """claims (claim, claim_type, statement, sorted subjects), those of several rows with the subjects of them all. Claims are shuffled whole only if a hash of them occurs twice."""
    same = ["claim", "claim_type", "statement"]
    if claims.groupBy(F.xxhash64(*same).alias("h")).count().where("count > 1").limit(1).count() == 0:
        return claims
    return claims.withColumn("subject", F.explode("subjects")).groupBy(*same).agg(F.sort_array(F.collect_set("subject")).alias("subjects"))


def contradiction_groups(new: DataFrame, old: DataFrame) -> DataFrame:
    """Who contradicts whom, a row for each subject, type and statement: new_claims and old_claims that state it, and contradicted, the old claims that its new ones contradict.

    Claims with equal statements contradict the same ones: all of the key's that state something else. So groups of claims stand for their pairs, of which there are
    new_claims x contradicted, and a key costs as many rows as it has statements. Claims belong to groups by those three columns; contradictions lists
    the pairs of the claims that it is given. Null subjects, types and statements contradict nothing. subject may be an array subjects, as there; each element is a subject then.
    """
    keys = ["subject", "claim_type"]
    listed = "subjects" in new.columns
    each = [(x.withColumn("subject", F.explode(F.array_distinct("subjects"))) if listed else x).select(*keys, "statement", F.lit(k).alias("k")) for k, x in enumerate((new, old))]
    groups = each[0].union(each[1]).dropna().groupBy(*keys, "statement").agg(F.count_if(F.col("k") == 0).alias("new_claims"), F.count_if(F.col("k") == 1).alias("old_claims"))
    total = groups.groupBy(*keys).agg(F.sum("old_claims").alias("_all"))
    return groups.join(total, keys).withColumn("contradicted", F.col("_all") - F.col("old_claims")).drop("_all").where((F.col("new_claims") > 0) & (F.col("contradicted") > 0))


def first_contradictions(claims: DataFrame) -> DataFrame:
    """claims (claim, pos, subject, claim_type, statement) -> (claim, other): the first earlier claim that contradicts each one.

    Of a subject and type, two claims decide: the first, and the first that states something else. A later claim contradicts
    the first if it differs from it, else the second. Two grouped minima and joins: no pairs, and a crowded key is
    combined before it is shuffled.
    """
    keys = ["subject", "claim_type"]
    at = F.struct("pos", "claim", "statement")
    first = claims.groupBy(*keys).agg(F.min(at).alias("one"))
    told = claims.join(first, keys)
    second = told.where(F.col("statement") != F.col("one.statement")).groupBy(*keys).agg(F.min(at).alias("two"))
    both = told.join(second, keys)
    other = F.when(F.col("statement") != F.col("one.statement"), F.col("one.claim")).when(F.col("two.pos") < F.col("pos"), F.col("two.claim"))
    return both.select("claim", "claim_type", other.alias("other")).where("other is not null")


def merge_claims(state: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, conflicts, counters): new claims are appended in the order of claim, after those of the state.

    A new claim that contradicts one before it, of the state or new, makes a conflict with the first such; both are challenged. A conflict has two edges.
    counters: attempted, accepted, rejected, contradictions, conflict_nodes.
    """
    all_ = state.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    found = first_contradictions(all_.withColumn("pos", F.struct("_new", "claim"))).join(new.select("claim"), "claim", "left_semi")
    hit = found.select("claim").union(found.select("other")).distinct().withColumn("_hit", F.lit(True))
    marked = all_.join(hit, "claim", "left").withColumn("status", F.when(F.col("_hit"), "challenged").otherwise(F.col("status"))).drop("_hit")
    edge = lambda to: F.struct(F.col("claim").alias("from"), F.col(to).alias("to"), F.lit("contradicts").alias("relation"))
    conflicts = found.select("claim", "other", "claim_type", F.array("other", "claim").alias("affected"), F.array(edge("other"), edge("claim")).alias("edges"))
    # A rejected claim is challenged by its own conflict; what a later one challenges was accepted before.
    judged = new.select("claim").join(found.select("claim", F.lit(True).alias("_hit")).distinct(), "claim", "left")
    n, hits = F.count("*"), F.count_if("_hit")
    counters = judged.agg(n.alias("attempted"), (n - hits).alias("accepted"), hits.alias("rejected"), hits.alias("contradictions"), hits.alias("conflict_nodes"))
    return marked.drop("_new"), conflicts, counters


def distinct_subjects(claims: DataFrame) -> DataFrame:
    """The number of distinct subjects over list-valued claims."""
    return claims.select(F.explode("subjects").alias("subject")).agg(F.count_distinct("subject").alias("subjects"))


def check_fields(rows: DataFrame, key: str, kind: str, fields: list[str], allowed: DataFrame) -> DataFrame:
    """(key, format, field) for each field that is set though the table allowed (format, field) lacks it."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    long = rows.select(key, F.col(kind).alias("format"), F.expr(f"stack({len(fields)}, {pairs}) as (field, value)")).where("value is not null")
    return long.join(small(allowed), ["format", "field"], "left_anti").select(key, "format", "field")


def codes_table(spark: SparkSession, kind: str) -> DataFrame:
    """(code, name) of the fixed units, line patterns or markers, as kind says: unit, line_pattern or marker."""
    return spark.createDataFrame([(k, n) for x, k, n in T.CODES if x == kind], "code long, name string")


def allowed_table(spark: SparkSession) -> DataFrame:
    """(format, field) of the fields that a block of each fixed format may set."""
    return spark.createDataFrame(T.ALLOWED, "format string, field string")


def decode_codes(df: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """df with the names of its codes."""
    return df.join(small(dim), key, how)


def apply_guarded(df: DataFrame, fn: Callable[[dict], int], keys: list[str]) -> DataFrame:
    """fn for each row, which returns the bytes it made: keys, status, error_message, bytes, ms. A failure is a row, never raised."""

    def run(batches):
        for p in batches:
            out = []
            for row in p.to_dict("records"):
                began = time.perf_counter()
                try:
                    got = ("success", None, int(fn(row)))
                except Exception as e:
                    got = ("error", f"{type(e).__name__}: {e}"[:500], None)
                out.append([row[k] for k in keys] + [*got, round(1000 * (time.perf_counter() - began), 3)])
            yield pd.DataFrame(out, columns=[*keys, "status", "error_message", "bytes", "ms"]).astype({"bytes": "Int64"})

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInPandas(run, f"{schema}, status string, error_message string, bytes long, ms double")
