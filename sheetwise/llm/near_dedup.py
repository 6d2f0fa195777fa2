"""Near-duplicate groups of texts by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, cut, pieces, stored, table
from .graph import components

#: Permutations; each gives a minimum and a maximum. Two of them make a band of four values, so at a similarity of 0.8
#: a pair shares none of the 32 bands with a chance of about (1 - 0.8^4)^32, 5 in 100 million.
PERMUTATIONS = 64
BAND = 2
#: Bits of a set's parity sketch. Two sketches differ in at most as many bits as the sets differ in members, so that a
#: large difference rules a pair out for certain.
PARITY = 2048
#: Members of one bucket that are compared at a time, and rows of such comparisons that a task gets, about.
CHUNK = 1024
TASK_ROWS = 40_000
#: Words whose hashes a task remembers.
KNOWN = 200_000

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_BAND_MUL = _rng.integers(0, 2**63, 2 * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; known remembers words' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z and splits at SPACES only
    if not found:
        return np.empty(0, np.uint64)
    if len(known) > KNOWN:
        known.clear()
    out = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    h = np.array(out, np.uint64)
    if len(h) < n:
        n = len(h)
    at = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        at = _mixed(at * _SEED + h[k : len(h) - n + 1 + k])
    return np.unique(at)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a non-empty set under each permutation, (PERMUTATIONS, 2)."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(s), 4096):
        x = s[None, k : k + 4096] * _MUL[:, None] + _ADD[:, None]  # s is hashed already
        low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
    return np.stack([low, high], axis=1)


def parity(s: np.ndarray) -> bytes:
    """A bit for each of PARITY classes of hashes: whether the set has an odd number of them."""
    return np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY).astype(np.uint8) & 1).tobytes()


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash for each band of BAND permutations, distinct between bands."""
    rows = sig.reshape(PERMUTATIONS // BAND, 2 * BAND)
    return _mixed((rows * _BAND_MUL).sum(axis=1) + np.arange(len(rows), dtype=np.uint64) * _SEED)


def _fingerprints(n: int):
    def make(batches):
        known: dict[bytes, int] = {}
        for b in pieces(batches, 1):
            ids, counts, digests, sketches, hashes = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), n, known)
                ids.append(i)
                counts.append(len(s))
                if len(s):
                    sig = signature(s)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sketches.append(parity(s))
                    hashes.append(bands(sig).view(np.int64))
                else:
                    digests.append(None)
                    sketches.append(None)
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "sketch", "bands"],
            )

    return make


def _sets(n: int):
    def make(batches):
        known: dict[bytes, int] = {}
        for b in pieces(batches, 2):
            ids, sets = [], []
            for i, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = shingles(t.as_py(), n, known).tobytes()
                if xxhash.xxh3_128_digest(s) == d:
                    ids.append(i)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])

    return make


def _confirm(percent: int):
    def make(batches):
        for b in pieces(batches, 3):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return make


def _across(percent: int):
    """The pairs of chunk pairs of buckets that lie in different components and whose sketches don't rule them out."""

    def make(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["bucket", "i", "j"], kind="stable")
        sketch = np.frombuffer(b"".join(p["sketch"]), np.uint64).reshape(len(p), -1)
        ids, comp, left, right, n = (p[c].to_numpy() for c in ("id", "comp", "left", "right", "n"))
        cell = p[["bucket", "i", "j"]].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, [len(p)]])
        a, b = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            cols = lo + np.flatnonzero(right[lo:hi])
            for i in lo + np.flatnonzero(left[lo:hi]):
                c = cols[comp[cols] != comp[i]]
                if len(c):
                    differ = np.bitwise_count(sketch[c] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                    c = c[(100 + percent) * differ <= (100 - percent) * (n[c] + n[i])]
                    a += [ids[i]] * len(c)
                    b += ids[c].tolist()
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64").drop_duplicates()

    return make


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs (id, text) -> (id, n_shingles, component_id, kept).

    Documents whose sets of lower-cased (A-Z) word shingles have 100 * intersection >= percent * union are linked.
    Equal sets are one class from the start. Classes that share a band first meet the one of their buckets that has most
    partners, then that of most partners outside its component; what then still lies in different components of one bucket is compared chunk by chunk, so that no link between
    different components is left out and a group of n near copies costs n confirmations, not n squared.
    Null or wordless text: empty set, linked with nothing. Null id: component null, not kept, and no one's partner.
    Repeated rows: the same class. Different texts under one id: each row by its own text. Fewer words than a shingle: all of them are one. Empty input: no rows.
    """
    named = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    prints = stored(named.mapInArrow(_fingerprints(shingle), "id long, n long, digest binary, sketch binary, bands array<long>"), "prints")
    classes = prints.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("first"))
    # Classes go by numbers of their own: a document with two texts can be the first of two classes.
    reps = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    # One row a class: its first document's bands.
    tagged = prints.join(reps.select(F.col("digest").alias("d"), "first", "rep"), F.expr("digest = d AND id = first")).select("digest", "rep", "n", "sketch", "bands").dropDuplicates(["digest"])
    banded = tagged.select("rep", F.explode("bands").alias("bucket"))
    several = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("bucket", "m")
    members = stored(banded.join(several, "bucket").select("bucket", "rep", "m"), "members")
    # How many partners a class has over all its buckets: what others were copied from has most.
    degrees = cut(members.groupBy("rep").agg(F.sum("m").alias("degree")))
    needed = degrees.select("rep").join(reps.select("rep", "digest", F.col("first").alias("id")), "rep")
    sets = stored(
        needed.hint("shuffle_hash").join(named, "id").select("rep", "digest", "text").mapInArrow(_sets(shingle), "id long, set binary").dropDuplicates(["id"]), "sets"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        s, t = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        close = pairs.join(s, "a").join(t, "b").select("a", "b", "x", "y")
        return close.mapInArrow(_confirm(percent), "a long, b long")

    def towards_heads(comps: DataFrame | None) -> DataFrame:
        """One pair for each class: with the class of most partners among the heads of its buckets.

        Given components, a bucket's head is sought outside the component of its first head, and meets those outside its own.
        """
        rated = members.join(degrees, "rep").select("bucket", "rep", F.struct("degree", (-F.col("rep")).alias("o")).alias("d"))
        if comps is None:
            heads = rated.groupBy("bucket").agg(F.max("d").alias("h")).select("bucket", "h", F.lit(None).cast("long").alias("hc"))
            met = rated.join(heads, "bucket").where(F.col("rep") != -F.col("h.o"))
        else:
            rated = rated.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            # The two components of most partners in each bucket.
            best = rated.groupBy("bucket", "comp").agg(F.max("d").alias("d")).groupBy("bucket").agg(F.max(F.struct("d", "comp")).alias("one"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
            others = rated.join(best.select("bucket", F.col("one.comp").alias("c1")), "bucket").where("comp <> c1")
            heads = others.groupBy("bucket").agg(F.max(F.struct("d", "comp")).alias("t")).select("bucket", F.col("t.d").alias("h"), F.col("t.comp").alias("hc"))
            met = rated.join(heads, "bucket").where("comp <> hc")
        # One row a class; that two are each other's heads is rare, and their pair is then confirmed twice.
        pairs = met.groupBy("rep").agg(F.max("h").alias("h")).select(F.col("rep"), (-F.col("h.o")).alias("head"))
        return pairs.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))

    links = cut(confirmed(towards_heads(None)))
    comps = cut(components(links))
    # What is known of components stands for the links they come from.
    stars = comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    comps = cut(components(stars.union(cut(confirmed(towards_heads(comps))))))

    # What is left: buckets whose members lie in several components.
    comp = F.coalesce("comp", "rep")
    placed = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", comp.alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
    placed = cut(placed.join(mixed, "bucket"))
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("big"), F.sum("m").alias("all")).select(
        "bucket", F.col("big.comp").alias("big"), F.ceil(F.col("big.m") / CHUNK).alias("bigs"), F.ceil((F.col("all") - F.col("big.m")) / CHUNK).alias("rests")
    )
    # Members of the largest component meet the others, and the others meet each other; both sides in chunks.
    dealt = placed.join(most, "bucket").join(tagged.select("rep", "n", "sketch").dropDuplicates(["rep"]), "rep")
    salt = lambda n: F.pmod(F.xxhash64("rep", "bucket"), n)
    row = lambda i, j, left, right: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    mine = salt(F.col("rests"))
    as_big = F.transform(upto(F.col("rests")), lambda j: row(salt(F.col("bigs")), j, True, False))
    as_rest = F.concat(
        F.transform(upto(F.col("bigs")), lambda i: row(i, mine, False, True)),
        F.transform(upto(F.col("rests")), lambda j: row(-1 - F.least(mine, j), F.greatest(mine, j), True, True)),
    )
    cells = dealt.select("bucket", F.col("rep").alias("id"), "comp", "n", "sketch", F.explode(F.when(F.col("comp") == F.col("big"), as_big).otherwise(as_rest)).alias("c")).select("bucket", "id", "comp", "n", "sketch", "c.*")
    # A member is repeated for each opposite chunk, so tasks are counted by these repeats.
    repeats = F.when(F.col("comp") == F.col("big"), F.col("rests")).otherwise(F.col("bigs") + F.col("rests"))
    tasks = blocks_for(placed.join(most, "bucket").agg(F.sum(repeats)).first()[0] or 0, TASK_ROWS)
    # A cell holds 2 * CHUNK rows at most, about; a task gets whole cells.
    pairs = cells.groupBy(F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(tasks)).alias("task")).applyInPandas(_across(percent), "a long, b long").distinct()
    more = cut(confirmed(cut(pairs)))
    stars = comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    comps = comps if more.isEmpty() else cut(components(stars.union(more)))

    # A component goes by the smallest id in it.
    linked = reps.join(comps.withColumnRenamed("id", "rep"), "rep").select("rep", "first", "comp")
    roots = linked.join(linked.groupBy("comp").agg(F.min("first").alias("root")), "comp").select("rep", "root")
    by_class = reps.join(roots, "rep", "left").select("digest", F.coalesce("root", "first").alias("root"))
    out = prints.select("id", "n", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 4-word shingles."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_duplicates(docs, shingle=4).withColumnRenamed("id", "doc_id")
