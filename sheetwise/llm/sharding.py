"""Contiguous shards of nearly equal bytes, cut from a global prefix sum of sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, parts, table


def shard_by_bytes(rows: DataFrame, shards: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """rows with shard and slot, in the order of key (null first), cut where the running size passes equal targets.

    Per-partition totals of a range-partitioned table give every partition its offset, so that no task sees more than
    its own range. A row goes where the middle of its bytes lies: each shard ends within half a row of its target.
    Nulls in size count as 0; rows with equal keys are told apart by their other columns and, if all are equal, by their
    place; slots number a shard's rows from 0. A column named shard, slot, _at, _pid, _start, _rows, _row or _first is
    replaced. Empty input: no rows. One key that holds most rows is spread over many ranges.
    """
    spark = rows.sparkSession
    own = ("shard", "slot", "_at", "_pid", "_start", "_rows", "_row", "_first")
    rows = cut(rows.drop(*own).withColumn("_at", F.monotonically_increasing_id()))
    cols = [c for c in rows.columns if c != "_at"]
    order = [F.col(key).asc_nulls_first(), F.col(size), F.xxhash64(*cols), F.col("_at")]
    ranged = cut(rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).drop("_at").withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("bytes"), F.count("*").alias("n"))
    # One row a partition: their number is a setting, not a function of the data.
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    offsets = totals.select(
        "_pid", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_start"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"), F.sum("bytes").over(every).alias("_total")
    )

    def place(batches):
        b = r = None
        for p in batches:
            if not len(p):
                continue
            s = p[size].fillna(0).to_numpy(np.int64)
            b = int(p["_start"].iloc[0]) if b is None else b
            r = int(p["_rows"].iloc[0]) if r is None else r
            ends = b + np.cumsum(s)
            total = int(p["_total"].iloc[0])
            # Python's integers: twice the middle times the number of shards may pass 64 bits at very large totals.
            cuts = np.array([-(-2 * k * total // shards) for k in range(1, shards)], np.int64)
            shard = np.searchsorted(cuts, 2 * ends - s, side="right") if total else np.zeros(len(s), np.int64)
            yield pd.DataFrame({**{c: p[c] for c in cols}, "shard": shard.astype(np.int32), "_row": r + np.arange(len(s), dtype=np.int64)})
            b, r = int(ends[-1]), r + len(s)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(cols).schema)
    placed = ranged.join(F.broadcast(offsets), "_pid").mapInPandas(place, f"{schema}, shard int, _row long")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select(*cols, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def op2_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_by_bytes(rows, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
