"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie kept as an edge table."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, stored, table
from .common import pieces as by_bytes

#: Words that take part: code points and occurrences at least; and how much more frequent than a word its form is.
LENGTH, TIMES, RATIO = 5, 3, 2
#: One in so many (document, run) pairs loses a code point.
NOISE = 97
#: Bytes of text that a task reads at once, and words that it counts before it hands them on.
BYTES, HELD = 4_000_000, 200_000
#: Ends every word in the trie; no word holds it.
STOP = "\n"

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")


def _windows(raw: bytes):
    """raw in windows of about BYTES that cut no run of letters."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BYTES)
        run = _RUN.search(raw, end - 1) if end < len(raw) else None
        if run and run.start() <= end:
            end = run.end()
        yield raw[at:end]
        at = end


def word_counts(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """docs (doc_id, text) -> word, n: lower-cased (A-Z only) runs of letters and how often they occur.

    A null doc_id counts as empty, repeated rows count each. Other columns are not read. Empty input: no rows. noise: where it divides the crc32 of '<doc_id>:<run>', the run's code point at crc32 % length is deleted; 0: nowhere. Null
    texts have no words. Long texts are read in windows; a task hands on sums by word.
    """

    def run(batches):
        found: Counter = Counter()

        def out():
            words = [w for w in found if w]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([found[w] for w in words], pa.int64())], names=["word", "n"])

        for b in by_bytes(batches, 1, BYTES):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if text is None:
                    continue
                own: Counter = Counter()
                for w in _windows(text.lower()):  # of bytes: only A-Z change
                    own.update(_RUN.findall(w))
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w, start)
                    if noise and h % noise == 0:
                        s = w.decode()
                        at = h % len(s)
                        w = (s[:at] + s[at + 1 :]).encode()
                    found[w] += n
            if len(found) >= HELD:
                yield out()
                found.clear()
        yield out()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    """The number of symbols that two words begin with alike."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # a[:low] is shared
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _chains(shared: list[int]) -> list[tuple[int, ...]]:
    """For each gap of a sorted run of words: the lengths, ascending, that words before it part at from the word after it.

    shared has what neighbours share. Of those lengths, the ones that count are the least so far, going back from the gap.
    """
    out, stack = [], []
    for n in shared:
        while stack and stack[-1] >= n:
            stack.pop()
        stack.append(n)
        out.append(tuple(stack))
    return out


def _borders(sums: list[tuple]) -> dict[int, tuple]:
    """part -> (chain from before, chain from behind, the word before it) for parts (part, first, last, chain from its end back, chain from its start on).

    As many rows as partitions. A chain goes on into the next part with what lies below all that was passed.
    """
    sums = sorted(sums)
    before, behind, prior = {}, {}, {}
    for walk, out, own in ((sums, before, 3), (sums[::-1], behind, 4)):
        chain: tuple = ()
        for k, row in enumerate(walk):
            if k:
                last = walk[k - 1]
                gap = _shared(last[2], row[1]) if own == 3 else _shared(row[2], last[1])
                low = tuple(c for c in (*chain, *last[own]) if c < gap)
                # What was passed in the part itself hides larger lengths beyond it.
                least = min(last[own], default=None)
                chain = tuple(sorted({c for c in low if c in last[own] or least is None or c < least} | {gap}))
                if own == 3:
                    prior[row[0]] = last[2]
            out[row[0]] = chain
    return {r[0]: (before[r[0]], behind[r[0]], prior.get(r[0])) for r in sums}


def trie_tables(words: DataFrame, least: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """words (word, distinct, least symbols each) -> (starts, edges) of two tries in compressed form, of the words and of the reversed words.

    edges (node, label, child, ends): nodes are prefixes that words part at, by hash; a label has all symbols up to the next one, the last of
    a word being STOP. Parts of the sorted words find their nodes from what neighbours share; what the parts' borders hide from each
    other passes through the driver, a few numbers a part. An edge is given once, by the first word that takes it. starts (text, at,
    node): the states without an edit, which follow their own word, at its nodes in the later half. Nodes that no start reaches are left out.
    """
    spark = words.sparkSession
    half = F.floor(F.length("word") / 2).cast("int")
    forward = words.select(F.concat(F.lit("f"), "word", F.lit(STOP)).alias("t"), (half + 1).alias("from"))
    back = words.select(F.concat(F.lit("b"), F.reverse("word"), F.lit(STOP)).alias("t"), (F.length("word") - half + 1).alias("from"))
    ranged = cut(forward.union(back).repartitionByRange(parts(spark), "t").sortWithinPartitions("t"))

    def read(batches):
        t, at = [], []
        for b in batches:
            t += b.column(0).to_pylist()
            at += b.column(1).to_pylist()
        return t, at, [_shared(x, y) for x, y in zip(t, t[1:])]

    def part() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    def ends(batches):
        t, _, shared = read(batches)
        if t:
            yield pd.DataFrame({"part": [part()], "first": [t[0]], "last": [t[-1]], "back": [list((_chains(shared) or [()])[-1])], "on": [list((_chains(shared[::-1]) or [()])[-1])]})

    def pandas_ends(frames):
        return ends(pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames)

    sums = ranged.mapInPandas(pandas_ends, "part int, first string, last string, back array<int>, on array<int>").collect()
    borders = spark.sparkContext.broadcast(_borders([tuple(r) for r in sums]))
    top = least // 2 + 1

    def build(batches):
        from xxhash import xxh64_intdigest

        t, start, shared = read(batches)
        if not t:
            return
        before, behind, prior = borders.value[part()]
        first = _shared(prior, t[0]) if prior else 0
        left = _chains([*before, *shared])[len(before) :] if shared or before else []
        right = _chains([*behind, *shared[::-1]])[len(behind) :][::-1] if shared or behind else []
        node = lambda x: xxh64_intdigest(x.encode()) - 2**63
        rows: list[list] = [[], [], [], [], [], []]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["text", "at", "node", "label", "child", "ends"])

        for k, x in enumerate(t):
            a = left[k - 1] if k else before
            b = right[k] if k < len(t) - 1 else behind
            path = sorted(n for n in {*a, *b} if n >= top)
            new = shared[k - 1] if k else first
            known = [node(x[:n]) for n in path]
            for i, n in enumerate(path):
                if n >= start[k]:
                    for c, v in zip(rows, (x, n, known[i], None, None, None)):
                        c.append(v)
                to = path[i + 1] if i + 1 < len(path) else len(x)
                if to > new:
                    last = to == len(x)
                    for c, v in zip(rows, (None, None, known[i], x[n:to], None if last else known[i + 1], last)):
                        c.append(v)
            if len(rows[0]) >= 20_000:
                yield out()
                for c in rows:
                    c.clear()
        yield out()

    made = stored(ranged.mapInArrow(build, "text string, at int, node long, label string, child long, ends boolean"), "trie")
    return made.where("text is not null").select("text", "at", "node"), made.where("label is not null").select("node", "label", "child", "ends")


def neighbours(words: DataFrame, least: int = LENGTH) -> DataFrame:
    """words (word, distinct, of least code points) -> word, near: all ordered pairs of words that differ by one code point inserted, deleted or replaced.

    States (word, near, at, node) go down a trie level by level, each step a join with the edge table. Without an edit they follow their
    own word, whose nodes are known from building the trie; at each of them every other branch takes the one edit, since it is made where word and near first differ. From there on near is fixed, and a
    state lives as long as there are edges for it; at a word's end it has found a neighbour. Only the later half of a word is
    edited: a pair that differs first in the earlier half of word meets in the trie of the reversed words. Words may be of any length; no words: no pairs.
    """
    spark = words.sparkSession
    starts, edges = trie_tables(words, least)
    edges = cut(edges.repartition(parts(spark), "node"))
    symbol, first, size = F.substring("text", F.col("at") + 1, F.lit(1)), F.substring("label", 1, 1), F.length("label")
    # An edit takes so many symbols of the word and gives so many of the label.
    turn = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(l).alias("l")) for w, l in ((1, 1), (0, 1), (1, 0))])).alias("turn")
    w, l = F.col("turn.w"), F.col("turn.l")
    fork = starts.join(edges, "node").where(symbol != first).select("*", turn).where(((w == 0) | (symbol != STOP)) & ((l == 0) | (first != STOP)))
    fork = fork.where(F.substring("text", F.col("at") + w + 1, size - l) == F.substring("label", l + 1, size - l))
    near = F.concat(F.substring("text", F.lit(1), F.col("at")), F.substring("label", F.lit(1), l), F.substring(F.col("text"), F.col("at") + w + 1, F.length("text")))
    states = stored(fork.select("text", near.alias("near"), (F.col("at") + size).alias("at"), F.col("child").alias("node"), "ends"), "states")
    found = [states.where("ends")]
    while True:
        states = states.where("NOT ends").select("text", "near", "at", "node")
        on = states.join(edges, "node").where(F.substring("near", F.col("at") + 1, size) == F.col("label"))
        states = stored(on.select("text", "near", (F.col("at") + size).alias("at"), F.col("child").alias("node"), "ends"), "states")
        if states.isEmpty():
            break
        found.append(states.where("ends"))
    pairs = reduce(DataFrame.union, found).select(F.substring("text", 1, 1).alias("trie"), *[F.expr(f"substring({c}, 2, length({c}) - 2)").alias(c) for c in ("text", "near")])
    # What the first trie finds too is its own; and nodes are told apart by hash: what two nodes of one hash let through ends here.
    half = F.floor(F.length("text") / 2).cast("int")
    early = F.substring(F.reverse("text"), F.lit(1), half) != F.substring(F.reverse("near"), F.lit(1), half)
    own = pairs.where(((F.col("trie") == "f") | early) & (F.levenshtein("text", "near", 1) == 1))
    turned = lambda c: F.when(F.col("trie") == "f", F.col(c)).otherwise(F.reverse(c)).alias
    return own.select(turned("text")("word"), turned("near")("near"))


def spelling_forms(counts: DataFrame, length: int = LENGTH, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """counts (word, n) -> word, n, n_near, form, form_n, root, for words of length code points and times occurrences at least.

    A word's form is its neighbour of largest n, ties to the smallest in code-point order, if that n is ratio times its own or
    more, else null. Forms grow in n, so following them ends; roots are found by doubling steps. Words without neighbours are their own root.
    No words: no rows.
    """
    words = stored(counts.where((F.length("word") >= length) & (F.col("n") >= times)).select("word", "n"), "words")
    pairs = neighbours(words.select("word"), length)
    rated = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = rated.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    own = words.join(best, "word", "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    own = stored(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    jumps = own.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = cut(jumps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        jumps = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return own.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_forms(word_counts(table(spark, sf_dir, "documents")))
