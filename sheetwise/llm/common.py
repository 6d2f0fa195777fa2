"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or one in the warehouse where it names none, which off a local master may not be a machine's own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named, top = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not named and top.startswith(("file:", "/")) and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or f"{top}/_checkpoints")
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


#: Whether a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def once(spark: SparkSession):
    """What is made and run in here is run once: its shuffle files go with it, so that long chains of steps don't pile them up."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    with once(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with once(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(batches, text: int, most: int = 4_000_000, rows: int = 256):
    """Arrow batches cut so that their text columns hold about most bytes in rows rows at most, which bounds what a task has in memory."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.column(text).slice(at, n).nbytes > most:
                n //= 2
            yield batch.slice(at, n)
            at += n


#: Items that are carried through one after the other; arrays of this many are then joined.
CHUNK = 128
#: Code points of the slices that a text is cut into, to reach its places without reading it from the start.
SLICE = 4096


def carried(items: Column, start: Column, step, kind: str) -> Column:
    """What step makes of each item, in order: step(state, item) -> (state, output); outputs are of type kind.

    Chunks keep the copying of growing arrays short, so that time follows the number of items.
    """
    none = F.lit([]).cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        return let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    chunks = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(CHUNK)), lambda k: F.slice(items, k, F.lit(CHUNK)))
    whole = F.aggregate(
        chunks, F.struct(start.alias("state"), F.lit([]).cast(f"array<array<{kind}>>").alias("out")),
        lambda a, c: let(
            F.aggregate(c, F.struct(a["state"].alias("state"), none.alias("out")), one),
            lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")),
        ),
    )
    return F.when(F.size(items) > 0, F.flatten(whole["out"])).otherwise(none)


def located(text: Column, pattern: str) -> Column:
    """(start, end, text) of each match of a pattern, in order, in code points; null if there is none.

    Splitting at a pattern gives the gaps between its matches, whose lengths give the places.
    """

    def step(at: Column, x: Column) -> Column:
        return let(at + F.length(x["g"]), lambda s: let(s + F.length(x["m"]), lambda e: F.struct(
            e.alias("state"), F.struct(s.alias("start"), e.alias("end"), x["m"].alias("text")).alias("out")
        )))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return let(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda p: carried(p, F.lit(0), step, "struct<start:int,end:int,text:string>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)))


def sliced(text: Column) -> Column:
    """A text as slices of SLICE code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}+"), F.lit(0))


def part(slices: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end of a sliced text; reads only the slices that hold them. Beyond the end: nothing."""
    first, last = F.floor(start / SLICE).cast("int"), F.floor((end - 1) / SLICE).cast("int")
    at = F.pmod(start, F.lit(SLICE)) + 1
    there = lambda i: F.coalesce(F.get(slices, i), F.lit(""))
    return F.when(end <= start, "").when(first == last, F.substring(there(first), at, end - start)).otherwise(F.concat(
        F.substring(there(first), at, F.lit(SLICE)),
        F.array_join(F.slice(slices, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(there(last), F.lit(1), F.pmod(end - 1, F.lit(SLICE)) + 1),
    ))
