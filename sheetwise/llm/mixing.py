"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, parts, table

#: The weights of the sources in the order of their names, repeating.
CYCLE = (5, 2, 1)
#: No document is taken more often.
MOST = 3
#: Newton steps at most; brackets halve where a step leaves them, so this many settle every source.
STEPS = 60
#: A source is settled when its tokens are this near to its target, as a share.
NEAR = 1e-9
#: Sources up to which their states (about 80 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Rows of one size within a source that are ranked together.
CELL_ROWS = 2000


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with the sums over all rows before each, in an order: within range partitions, plus those of the partitions before."""
    ranged = cut(rows.repartitionByRange(parts(rows.sparkSession), *order).withColumn("_pid", F.spark_partition_id()))
    own = W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # One row a partition: their number is a setting, not a function of the data.
    totals = ranged.groupBy("_pid").agg(*[F.sum(v).alias(f"_t{k}") for k, v in sums.items()])
    over = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_pid", *[F.coalesce(F.sum(f"_t{k}").over(over), F.lit(0)).alias(f"_t{k}") for k in sums])
    inside = ranged.withColumns({k: F.coalesce(F.sum(v).over(own), F.lit(0)) for k, v in sums.items()})
    return inside.join(F.broadcast(starts), "_pid").select(*rows.columns, *[(F.col(k) + F.col(f"_t{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target: weighted shares of the whole, none above MOST times its own size.

    Sources come by code point, null last. What a capped source can't take is shared again by weight; the end of that is
    one level t with target = min(MOST * size, t * weight), found in the order of the levels at which each source is full.
    Both orders are running sums over range partitions; two sums and one level are all that the driver sees.
    """
    byname = F.col("source").asc_nulls_last()
    w = F.element_at(F.array(*[F.lit(x) for x in CYCLE]), (F.col("nth") % len(CYCLE) + 1).cast("int"))
    named = _before(sizes, [byname], nth=F.lit(1).cast("long")).withColumn("weight", w.cast("long")).withColumn("cap", MOST * F.col("source_size")).drop("nth")
    leveled = cut(_before(named.withColumn("level", F.col("cap").cast("double") / F.col("weight")), [F.col("level"), byname], taken=F.col("cap"), spent=F.col("weight")))
    every = leveled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    t = (F.lit(float(every["size"] or 0)) - F.col("taken")) / (F.lit(every["weight"]) - F.col("spent"))
    # The first source, in this order, that its share doesn't fill sets the level; without any, all are full.
    found = leveled.agg(F.min(F.when(F.col("level") > t, F.struct("level", t.alias("t")))).alias("f")).first()["f"]
    target = F.col("cap").cast("double") if found is None else F.least(F.col("cap").cast("double"), F.lit(found["t"]) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def _sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,9)"))


def tilts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, tilt): the solution of the dual, min(MOST, exp(tilt * size / mean)) tokens near each source's target.

    cells (source, size, n) is a sufficient statistic of the documents: every Newton step sums over it, source by source.
    """
    mean = F.col("source_size") / F.col("docs")
    state = cells.groupBy("source").agg(F.sum("n").alias("docs")).join(targets, F.expr("source <=> s")).select(
        "source", "target", mean.alias("mean"),
        # Full sources take MOST of everything, and unchanged ones 1.
        (F.col("target") < F.col("source_size") * MOST * (1 - 1e-12)).alias("open"),
        F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"),
    )
    state = cut(state)
    hint = F.broadcast if state.count() <= BROADCAST_SOURCES else (lambda x: x)
    cells = cells.withColumnRenamed("source", "s")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        # An exponent above what MOST needs changes nothing.
        rate = F.least(F.lit(float(MOST)), F.exp(F.least(F.col("tilt") * x, F.lit(2.0))))
        tokens = F.col("n") * F.col("size") * rate
        went = F.when(rate < MOST, tokens * x).otherwise(0.0)
        sums = (
            cells.join(hint(state.where("open")), F.expr("s <=> source"))
            .groupBy("source").agg(_sum(tokens).cast("double").alias("got"), _sum(went).cast("double").alias("slope"))
        ).withColumnRenamed("source", "s")
        step = state.join(sums, F.expr("s <=> source"), "left")
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(off > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - F.try_divide(off, F.col("slope"))
        step = step.select("source", "target", "mean", "open", "got", lo.alias("lo"), hi.alias("hi"), newton.alias("next"), "tilt")
        done = F.col("got").isNull() | (F.abs(F.col("got") - F.col("target")) <= NEAR * F.col("target") + 1e-6) | (F.col("hi") - F.col("lo") < 1e-12)
        inside = (F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi"))
        state = cut(step.select(
            "source", "target", "mean", (F.col("open") & ~done).alias("open"),
            F.when(done | ~F.col("open"), F.col("tilt")).when(inside, F.col("next")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"), "lo", "hi",
        ))
        if state.where("open").isEmpty():
            break
    return state.select("source", "tilt", "mean", "target")


def _round(p: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell of one source, from large documents to small; what rounding leaves goes to the next cell."""
    p = p.sort_values("size", ascending=False)
    left, out = 0.0, []
    for s, n, rate in zip(p["size"], p["n"], p["rate"]):
        if s == 0:
            out.append(0)
            continue
        c = min(MOST * n, max(0, round(n * rate + left / s)))
        left += (n * rate - c) * s
        out.append(c)
    return p.assign(copies=out)[["source", "size", "n", "copies"]]


def mix(docs: DataFrame) -> DataFrame:
    """docs (key, source, size) with source_size, target and copies, 0 to MOST of each document.

    Source by source, the rates nearest to 1 in relative entropy that give the target are exp(tilt * size), held at MOST.
    Newton's method finds the tilts from the sums over (source, size, n); rounding carries what is left from the large
    sizes to the small, so that a source misses its target by less than its small documents. Documents of one size
    share the copies by a hash of their key. Null source: a source of its own, the last. Null size: 0. Documents of
    size 0 are never taken. Repeated rows count each; of rows alike in all, any may be taken more often. Long documents count by their size
    alone. Only key, source and size are read, so other columns can have any name. Empty input: no rows.
    """
    docs = cut(docs.select("key", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    cells = cut(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(source_targets(cut(sizes)))
    solved = tilts(cells, targets.withColumnRenamed("source", "s"))
    x = F.col("size") / F.col("mean")
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    rate = F.when(full, F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("tilt") * x, F.lit(2.0)))))
    rated = (
        cells.join(solved.select(F.col("source").alias("s"), "tilt", "mean"), F.expr("source <=> s")).drop("s")
        .join(targets.withColumnRenamed("source", "s"), F.expr("source <=> s")).select("source", "size", "n", rate.alias("rate"))
    )
    # At most one row for each size that a source has, however many its documents.
    kind = docs.schema["source"].dataType.simpleString()
    copies = cut(rated.groupBy("source").applyInPandas(_round, f"source {kind}, size long, n long, copies long"))
    salt = F.pmod(F.xxhash64("key", "source", "size"), F.ceil(F.col("n") / CELL_ROWS))
    own = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("size") == F.col("z"))
    dealt = docs.join(copies.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "copies"), own).drop("s", "z").withColumn("part", salt)
    # Ranks within a cell: those of the parts before, from their counts, and the rank within the part.
    several = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    before = several.withColumn("before", F.sum("m").over(W.partitionBy("source", "size").orderBy("part")) - F.col("m"))
    ranked = dealt.withColumn("r", F.row_number().over(W.partitionBy("source", "size", "part").orderBy(F.xxhash64("key", F.lit(7)), "key")) - 1)
    same = (ranked["source"].eqNullSafe(before["source"])) & (ranked["size"] == before["size"]) & (ranked["part"] == before["part"])
    rank = F.col("r") + F.col("before")
    each = F.floor(F.col("copies") / F.col("n"))
    got = each + F.when(rank < F.col("copies") - each * F.col("n"), 1).otherwise(0)
    with_copies = ranked.join(before, same).select("key", ranked["source"], ranked["size"], got.cast("int").alias("copies"))
    return with_copies.join(targets.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and how many of their words the mix takes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", n_words(F.col("text")).alias("size"))
    return mix(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
