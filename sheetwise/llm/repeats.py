"""Repeated byte strings across documents, from interval trees of sparse suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks_for, pieces, stored, table

#: Bytes of the grams whose least hash names a window.
GRAM = 32
#: Bytes of text that one suffix array holds, about.
BLOCK_BYTES = 2_000_000
#: Bytes of a name's distinct passages above which they are named again, by their next hash, before they meet.
NAME_BYTES = 2_000_000
#: How often passages are named again; what is still too much under one name then is told apart window by window.
DEPTHS = 3
#: Windows of a passage that are hashed at a time.
WINDOWS = 200_000
#: Columns of runs.
RUNS = "id long, doc long, name long, place long, digest long"
#: Symbols that the first ranks of suffixes are made of, nine bits each.
SYMBOLS = 7

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_RINV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n at least."""
    if len(_pow.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, r in (("up", _R), ("down", _RINV)):
            p = np.full(size, r, _U)
            p[0] = 1
            _pow[name] = np.multiply.accumulate(p)
    return _pow["up"], _pow["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def _rolling(b: np.ndarray, width: int) -> np.ndarray:
    """A hash of every substring of width bytes."""
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)], out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * down[: len(b) - width + 1])


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(m) - (width - have)], m[width - have :])


def runs(b: np.ndarray, width: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, lo, hi, inner): the runs of window starts lo..hi whose windows share their least gram hash, the name.

    Every depth has a hash of its own.

    A window's name depends on its bytes alone, so equal windows, wherever they start, lie in runs of one name. inner:
    a window may repeat within the run; false only where none does.
    """
    grams = min(GRAM, width)
    h = _rolling(b, grams)
    if depth:
        h = _mixed(h ^ (_R * _U(depth)))
    m = _sliding_min(h, width - grams + 1)
    lo = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    hi = np.concatenate([lo[1:], [len(m)]]) - 1
    name = m[lo]
    # A window that repeats within its run gives the run a period, so that the name is the first gram of one of its
    # windows and, later in the text, the last gram of another.
    span = width - grams
    starts, ends = np.flatnonzero(h[: len(m)] == m), np.flatnonzero(h[span:] == m)
    first, last = np.full(len(lo), len(h)), np.zeros(len(lo), np.int64)
    first[np.searchsorted(lo, starts[::-1], side="right") - 1] = starts[::-1]
    last[np.searchsorted(lo, ends, side="right") - 1] = ends + span
    inner = last > first
    return name, lo, hi, inner


def _scan(width: int, depth: int):
    """(id, text) -> one row a run: hashes of its document, its name and its bytes, and its place as one number."""

    def make(batches):
        for batch in pieces(batches, 1):
            ids, docs, names, places, digests = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_buffer() if t.is_valid else None
                if raw is None or raw.size < width:
                    continue
                name, lo, hi, inner = runs(np.frombuffer(raw, np.uint8), width, depth)
                view = memoryview(raw)
                ids += [i] * len(lo)
                docs.append(np.full(len(lo), _text_hash(raw)))
                names.append(name.view(np.int64))
                places.append((lo << 32) + ((hi - lo) << 1) + inner)
                digests += [xxhash.xxh3_64_intdigest(view[x : y + width]) for x, y in zip(lo.tolist(), hi.tolist())]
            if ids:
                cat = np.concatenate
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cat(docs)), pa.array(cat(names)), pa.array(cat(places)), pa.array(np.array(digests, _U).view(np.int64))],
                    names=["id", "doc", "name", "place", "digest"],
                )

    return make


def _text_hash(raw) -> int:
    return xxhash.xxh3_64_intdigest(raw) - 2**63


def sorted_suffixes(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes of joined texts, sorted, and their ranks by SYMBOLS, 2 * SYMBOLS, ... leading bytes.

    ends[i]: where the text of place i ends. Prefix doubling: every round sorts only suffixes that share their rank, by the
    rank of what follows; a suffix that has ended comes before all others, by its text. Integers only: memory is some
    dozen bytes a place, and four more a round.
    """
    n = len(b)
    at = np.arange(n)
    padded = np.concatenate([b.astype(np.int64) + 1, np.zeros(SYMBOLS, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(SYMBOLS):
        key = (key << 9) | np.where(at + j < ends, padded[j : j + n], 0)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    levels, k = [(SYMBOLS, rank)], SYMBOLS
    while len(slots):
        own = order[slots]
        after = own + k
        going = after < ends[own]
        # An end is told from other ends by its place, which lies before that of no rank.
        second = np.where(going, n + rank[np.where(going, after, 0)], ends[own] - 1)
        both = rank[own].astype(np.int64) * (2 * n) + second
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[slots] = own
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        size = np.diff(np.append(first, len(own)))
        rank = rank.copy()
        rank[own] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        k *= 2
        if len(slots):
            levels.append((k, rank))
    return order, levels


def common_prefixes(b: np.ndarray, ends: np.ndarray, levels: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at x and y: the largest equal rank first, single bytes last."""
    got = np.zeros(len(x), np.int64)
    stop = np.minimum(ends[x] - x, ends[y] - y)
    for k, rank in reversed(levels):
        on = np.flatnonzero(got < stop)
        on = on[rank[x[on] + got[on]] == rank[y[on] + got[on]]]
        got[on] = np.minimum(got[on] + k, stop[on])
    on = np.flatnonzero(got < stop)
    for _ in range(SYMBOLS - 1):
        on = on[b[x[on] + got[on]] == b[y[on] + got[on]]]
        got[on] += 1
        on = on[got[on] < stop[on]]
    return got


def suffix_intervals(texts: list[bytes], starts: list[int], width: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The repeat groups of a block: text and start of its sorted suffixes, and (length, first, last) of each group.

    starts[k] windows of texts[k] take part, from its first byte on. Suffixes whose first width bytes occur once are
    left out by a hash, and so are those that all follow the same byte; what holds the rest is sorted whole. The array's
    common-prefix lengths are scanned with a stack: every interval of the tree, down to
    width, is a group that can't be extended to the right, given by its range of suffixes, which are all its occurrences;
    groups that all extend to the left are not reported.
    """
    size = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(size)])
    b = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([base[k] + np.arange(n) for k, n in enumerate(starts)])
    h = np.concatenate([_rolling(b[base[k] : base[k + 1]], width)[:n] for k, n in enumerate(starts)])
    before = np.where(np.isin(at, base[:-1]), -1, b[at - 1].astype(np.int16))
    order = np.argsort(h)
    h, left = h[order], before[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(first, len(h)))
    low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    want = np.zeros(len(b), bool)
    want[at[order[np.repeat((count > 1) & ((low != high) | (low < 0)), count)]]] = True
    # Of each text, what begins at the first suffix that takes part.
    some = np.flatnonzero(np.add.reduceat(want, base[:-1]))
    if not len(some):
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    from_ = [base[k] + int(np.argmax(want[base[k] : base[k + 1]])) for k in some]
    place = np.concatenate([np.arange(x, base[k + 1]) for k, x in zip(some, from_)])
    length = np.array([base[k + 1] - x for k, x in zip(some, from_)])
    text, ends = np.repeat(some, length), np.repeat(np.cumsum(length), length)
    joined, want = b[place], want[place]
    order, levels = sorted_suffixes(joined, ends)
    order = order[want[order]]
    lcp = common_prefixes(joined, ends, levels, order[:-1], order[1:])
    del levels
    own = place[order]
    left = np.where(own == base[text[order]], -1, b[own - 1].astype(np.int16))
    return text[order], own - base[text[order]], _tree(np.where(lcp >= width, lcp, 0).tolist(), left, width)


def _tree(lcp: list[int], before: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least width, by a stack scan of the sorted suffixes."""
    # Suffixes up to each place that are told apart from the one before by the byte on their left, or start a text.
    apart = np.cumsum(np.concatenate([[0], (before[1:] != before[:-1])])).tolist()
    begins = np.cumsum(before < 0).tolist()
    groups, stack = [], []  # of (length, first)
    for k, n in enumerate([*lcp, 0]):
        start = k
        while stack and stack[-1][0] > n:
            length, start = stack.pop()
            if length >= width and (apart[k] > apart[start] or begins[k] > (begins[start - 1] if start else 0)):
                groups.append((length, start, k))
        if n and (not stack or stack[-1][0] < n):
            stack.append((n, start))
    return groups


def _longest(n: int, groups: list[tuple[int, int, int]]) -> np.ndarray:
    """For each of n sorted suffixes, the length of the innermost group that holds it; 0 for none."""
    out, open_ = [0] * n, []
    nested = sorted(groups, key=lambda g: (g[1], -g[2], g[0]))
    for (length, first, last), after in zip(nested, [*(g[1] for g in nested[1:]), n]):
        open_.append((last, length))
        k = first
        # Up to where the next group begins, the innermost open one holds.
        while k < after and open_:
            end, length = open_[-1]
            upto = min(end + 1, after)
            if upto > k:
                out[k:upto] = [length] * (upto - k)
                k = upto
            if end < after:
                open_.pop()
    return np.array(out, np.int64)


def merged(pairs) -> list[tuple[int, int]]:
    """Half-open intervals, joined where they touch."""
    out: list[list[int]] = []
    for x, y in sorted(pairs):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _chunks(p: pd.DataFrame):
    """A block's names, together as long as their bytes are few."""
    p = p.sort_values(["name", "digest"], kind="stable")
    size = p["bytes"].map(len).groupby(p["name"]).sum()
    chunk = (size.cumsum() - size) // BLOCK_BYTES
    for _, own in p.groupby(p["name"].map(chunk)):
        yield own


def _block(width: int):
    """One block of passages (name, digest, bytes, windows) -> the covered stretches of each."""

    def make(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own in _chunks(p):
            text, at, groups = suffix_intervals(own["bytes"].tolist(), own["windows"].tolist(), width)
            length = _longest(len(at), groups)
            some = length > 0
            text, x, y = text[some], at[some], (at + length)[some]
            by = np.lexsort((x, text))
            text, x, y = text[by], x[by], y[by]
            # Stretches of a text that touch are one.
            far = np.int64(1 << 40) * text
            reach = np.maximum.accumulate(y + far)
            first = np.flatnonzero(np.concatenate([[True] * (len(x) > 0), (x + far)[1:] > reach[:-1]]))
            if len(first):
                last = np.append(first[1:], len(x)) - 1
                k = text[first]
                out.append(pd.DataFrame({"name": own["name"].to_numpy()[k], "digest": own["digest"].to_numpy()[k], "x": x[first].astype(np.int32), "y": (reach[last] - far[last]).astype(np.int32)}))
        none = pd.DataFrame({"name": pd.Series(dtype="int64"), "digest": pd.Series(dtype="int64"), "x": pd.Series(dtype="int32"), "y": pd.Series(dtype="int32")})
        return pd.concat(out) if out else none

    return make


def _passages(width: int):
    """(doc, text, list of runs) -> the bytes of each run."""

    def make(batches):
        for batch in pieces(batches, 1, 1_000_000):
            names, digests, texts, windows, hot = [], [], [], [], []
            for d, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = t.as_buffer()
                if _text_hash(raw) != d:  # another text under the same id
                    continue
                view = memoryview(raw)
                for r in own:
                    lo, n = r["place"] >> 32, (r["place"] & 0xFFFFFFFF) >> 1
                    names.append(r["name"])
                    digests.append(r["digest"])
                    texts.append(view[lo : lo + n + width])
                    windows.append(n + 1)
                    hot.append(r["hot"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(digests, pa.int64()), pa.array(texts, pa.binary()), pa.array(windows, pa.int32()), pa.array(hot, pa.bool_())],
                names=["name", "digest", "bytes", "windows", "hot"],
            )

    return make


def _windows(width: int):
    """Passages -> a row for every window: its offset and a 128-bit digest."""

    def make(batches):
        names = ["name", "digest", "x", "own"]
        for batch in pieces(batches, 2, 500_000):
            for name, digest, t, windows in zip(*(batch.column(k).to_pylist() for k in range(4))):
                view = memoryview(t)
                for at in range(0, windows, WINDOWS):
                    n = min(WINDOWS, windows - at)
                    own = [xxhash.xxh3_128_digest(view[x : x + width]) for x in range(at, at + n)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.full(n, digest)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(own, pa.binary())], names=names)

    return make


def _removed(batches):
    """(id, text, stretches) -> what is left of each document."""
    for batch in batches:
        ids, total, gone, spans, left = [], [], [], [], []
        for i, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = memoryview(t.as_buffer()) if t.is_valid else memoryview(b"")
            cover = merged((x["x"], x["y"]) for x in own or ())
            at, h = 0, hashlib.sha256()
            for x, y in cover:
                h.update(raw[at:x])
                at = y
            h.update(raw[at:])
            ids.append(i)
            total.append(len(raw))
            gone.append(sum(y - x for x, y in cover))
            spans.append(len(cover))
            left.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in (total, gone, spans)), pa.array(left, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_stretches(docs: DataFrame, width: int = 400, depth: int = 0, found: DataFrame | None = None) -> DataFrame:
    """docs (id, text) -> (id, doc, x, y): stretches whose every byte lies in a width-byte string that starts elsewhere too.

    doc is a hash of the document's text. Stretches of one document may overlap. Passages that too many others share a
    name with are documents themselves, one depth further down, where another hash names their windows: stretches that all
    of them have become one passage there, and the rest comes under many names. found: the runs of docs, where the caller has named them.
    """
    found = stored(docs.mapInArrow(_scan(width, depth), RUNS) if found is None else found, "runs")
    # Most names occur once, in a run that doesn't repeat within itself: nothing of theirs goes further.
    shared = found.groupBy("name").agg(F.count("*").alias("n"), F.max(F.col("place") % 2).alias("inner")).where("n > 1 OR inner = 1").select("name")
    found = stored(found.join(shared.hint("shuffle_hash"), "name", "left_semi"), "shared")
    # Runs with equal bytes are one passage; what comes twice is repeated whole, with no need of its bytes.
    passages = stored(found.groupBy("name", "digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "doc", "place")).alias("at")), "passages")
    windows = F.shiftright(F.col("at.place").bitwiseAND(0xFFFFFFFF), 1) + 1
    kinds = passages.groupBy("name").agg(F.count("*").alias("kinds"), F.sum(windows + width - 1).alias("size"))
    # A passage can repeat in part if another has its name, or within itself.
    ask = passages.join(kinds, "name").where("kinds > 1 OR n = 1 AND at.place % 2 = 1").select(
        F.col("at.id").alias("id"), F.col("at.doc").alias("doc"), F.struct("name", "digest", F.col("at.place").alias("place"), (F.col("size") > NAME_BYTES).alias("hot")).alias("r")
    )
    lists = ask.groupBy(_key(F.col("id")).alias("k"), "doc").agg(F.collect_list("r").alias("r"))
    texts = docs.select(_key(F.col("id")).alias("k"), "text").join(lists.hint("shuffle_hash"), "k").select("doc", "text", "r")
    parts = stored(texts.mapInArrow(_passages(width), "name long, digest long, bytes binary, windows int, hot boolean"), "parts")
    size = parts.where("not hot").agg(F.sum(F.length("bytes"))).first()[0] or 0
    block = F.pmod(F.xxhash64("name"), F.lit(blocks_for(size, BLOCK_BYTES)))
    cool = parts.where("not hot").groupBy(block.alias("block")).applyInPandas(_block(width), "name long, digest long, x int, y int")
    cover = cool
    hot = parts.where("hot").dropDuplicates(["name", "digest"])
    if not parts.where("hot").isEmpty():
        cover = cover.union(_deeper(hot, width, depth + 1) if depth < DEPTHS else _single(hot, width))
    length = F.shiftright(F.col("at.place").bitwiseAND(0xFFFFFFFF), 1) + width
    twice = passages.where("n > 1").select("name", "digest", F.lit(0).alias("x"), length.cast("int").alias("y"))
    cover = cover.union(twice).groupBy("name", "digest").agg(F.collect_set(F.struct("x", "y")).alias("c"))
    own = found.join(cover, ["name", "digest"]).select("id", "doc", F.shiftright("place", 32).cast("int").alias("lo"), F.explode("c").alias("c"))
    return own.select("id", "doc", (F.col("lo") + F.col("c.x")).alias("x"), (F.col("lo") + F.col("c.y")).alias("y"))


def _deeper(hot: DataFrame, width: int, depth: int) -> DataFrame:
    """Covered stretches of passages (name, digest, bytes), named by the hash of a further depth."""
    inner = repeated_stretches(hot.select(F.col("digest").alias("id"), F.col("bytes").alias("text")), width, depth)
    return hot.select("name", F.col("digest").alias("id")).join(inner, "id").select("name", F.col("id").alias("digest"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def _single(hot: DataFrame, width: int) -> DataFrame:
    """Covered stretches of passages whose windows are groups of their own: counted, with partial counts before the shuffle."""
    grams = hot.select("name", "digest", "bytes", "windows").mapInArrow(_windows(width), "name long, digest long, x int, own binary")
    again = grams.groupBy("name", "own").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    # Windows of a passage that touch are one stretch.
    along = Window.partitionBy("name", "digest").orderBy("x")
    starts = F.coalesce(F.col("x") - F.lag("x").over(along) > width, F.lit(True)).cast("int")
    each = grams.join(again, ["name", "own"]).select("name", "digest", "x", starts.alias("s")).withColumn("s", F.sum("s").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("name", "digest", "s").agg(F.min("x").alias("x"), (F.max("x") + width).cast("int").alias("y")).drop("s")


def _key(c):
    return F.coalesce(c, F.lit(-(2**63)))


def without_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """docs (id, text) -> (id, n_bytes, n_removed, n_spans, kept_sha256): repeats of width bytes taken out, first ones too.

    Texts are judged as UTF-8 bytes. Null and empty texts: nothing to remove. Repeated rows: their texts repeat, so all
    of a text of width bytes or more goes. Null ids are returned as such. Very long texts are taken whole; one that repeats
    within itself, as a run of one letter, takes memory in proportion to its length. Only id and text are read, so
    other columns can have any name. Empty input: no rows.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    return with_stretches(docs, width).select("id", "text", "m").mapInArrow(_pick, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def with_stretches(docs: DataFrame, width: int) -> DataFrame:
    """docs (id, text as bytes) -> (k, id, text, m): a key of id that is never null, and the stretches of the texts under it."""
    cover = repeated_stretches(docs, width).groupBy("id", "doc").agg(F.collect_list(F.struct("x", "y")).alias("c"))
    # Different texts under one id are told apart in _removed's input by their hash.
    lists = cover.groupBy(_key(F.col("id")).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("doc", "c"))).alias("m"))
    return docs.withColumn("k", _key(F.col("id"))).join(lists.hint("shuffle_hash"), "k", "left")


def _pick(batches):
    """Of the stretches of an id, those of the text at hand."""
    for batch in pieces(batches, 1):
        own = []
        for t, m in zip(batch.column(1), batch.column(2).to_pylist()):
            own.append(dict(m).get(_text_hash(t.as_buffer())) if m and t.is_valid else None)
        kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
        yield from _removed([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, kind)], names=["id", "text", "own"])])


def op5_interval_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that start more than once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return without_repeats(docs).withColumnRenamed("id", "doc_id")
