"""Ranked lexical search by dual trees: bounds of pairs of item and document nodes against the items' weakest kept scores."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks_for, cut, stored, table
from .common import pieces as by_bytes

TOP = 50
#: Bits of the filter that terms of documents pass, and bytes of text that a task reads at once.
FILTER, BYTES = 1 << 22, 4_000_000
#: Terms of the items that are searched for together, about; larger sets of items are searched in blocks.
BLOCK = 50_000
#: Documents of a batch and of a leaf, and children of a node.
BATCH, LEAF, FAN = 2048, 32, 8
#: One document in so many is searched first. Its kth scores are lines that the kth scores of all can't lie below; they spare work and drop nothing.
SEED = 16

#: Letters and digits of ASCII and all that lies beyond it, in UTF-8.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> item_id, term: the distinct terms of each item."""
    terms = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def _filter(terms: DataFrame) -> bytes:
    """A bit for the hash of each term: as many bits as FILTER, whatever the number of terms."""
    bit = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(FILTER))
    words = terms.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")).alias("bits")).collect()
    out = np.zeros(FILTER // 32, "<u4")
    for at, bits in words:
        out[at] = bits
    return out.tobytes()


def document_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (terms, repeats counted), terms and tfs: those terms that may be among terms (term), and how often.

    Null texts have no terms. Texts are read whole.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def run(batches):
        known = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").tobytes()
        crc, mask = zlib.crc32, FILTER - 1
        for b in by_bytes(batches, 1, BYTES):
            n, names, tfs, ends = [], [], [], [0]
            for text in b.column(1).cast(pa.binary()).to_pylist():
                own = Counter(_TERM.findall(text.lower())) if text else {}
                n.append(sum(own.values()))
                for t, k in own.items():
                    if known[crc(t) & mask]:
                        names.append(t)
                        tfs.append(k)
                ends.append(len(names))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(names, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<long>")


class Items:
    """A block of items: their terms as columns, and a tree over them whose nodes hold the columns that any item below has."""

    def __init__(self, rows: list[tuple[int, str, int]], lines: dict):
        self.column = {t: k for k, t in enumerate(sorted({t for _, t, _ in rows}))}
        self.weight = np.zeros(len(self.column), np.int64)
        own: dict = {}
        for item, term, w in rows:
            self.weight[self.column[term]] = w
            own.setdefault(item, []).append(self.column[term])
        # Items that share their weightiest terms stand together.
        order = sorted(own, key=lambda i: (sorted(own[i], key=lambda c: (-self.weight[c], c))[:2], i))
        self.ids = order
        self.line = np.array([lines.get(i, 1) for i in order], np.float64)
        level = [(np.array(sorted(own[i])), (k, k + 1), []) for k, i in enumerate(order)]
        while len(level) > 1:
            level = [(np.unique(np.concatenate([x[0] for x in some])), (some[0][1][0], some[-1][1][1]), some) for some in (level[k : k + FAN] for k in range(0, len(level), FAN))]
        self.root = level[0]


class Search:
    """The best documents of a block's items among those that a task has seen."""

    def __init__(self, items: Items, most: int, count: int, total: int):
        self.items, self.most, self.count, self.total = items, most, count, total
        self.line = items.line.copy()
        self.best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.ids]

    def add(self, batch: pa.RecordBatch) -> None:
        """Search a batch (doc_id, n, terms, tfs)."""
        n = batch.column(1).to_numpy()
        ends = batch.column(2).offsets.to_numpy().astype(np.int64)
        names = batch.column(2).values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        tfs = batch.column(3).values.to_numpy()[ends[0] : ends[-1]]
        column = self.items.column
        col = np.array([column.get(t, -1) for t in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        some = col >= 0
        doc, col, tf = doc[some], col[some], tfs[some]
        # Python's integers where 64 bits might not do.
        m = np.array([100 - 50 + (50 * k * self.count) // self.total for k in n.tolist()], np.int64) if self.total else np.full(len(n), 50)
        impact = self.items.weight[col] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        doc, col, impact = doc[impact > 0], col[impact > 0], impact[impact > 0].astype(np.float64)
        if not len(doc):
            return
        # Documents that share their terms of most impact lie in one leaf.
        by = np.lexsort((-impact, doc))
        first = np.flatnonzero(np.diff(doc[by], prepend=-1))
        lead = np.full(len(n), len(column))
        lead[doc[by][first]] = col[by][first]
        then = np.full(len(n), len(column))
        second = first + 1
        second = second[(second < len(by)) & ~np.isin(second, first)]
        then[doc[by][second]] = col[by][second]
        order = np.lexsort((then, lead))[: len(np.unique(doc))]
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.argsort(doc, kind="stable")
        self.doc, self.col, self.impact = doc[by], col[by], impact[by]
        ids, none = batch.column(0), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        self.id, self.null = np.where(none, np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())[order], none[order]
        self.start = np.searchsorted(self.doc, np.arange(0, len(order) + LEAF, LEAF))
        leaves = -(-len(order) // LEAF)
        top = np.zeros((len(column), leaves))
        np.maximum.at(top, (self.col, self.doc // LEAF), self.impact)
        self.levels = [top]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))
        self._visit(self.items.root, len(self.levels) - 1, np.zeros(1, np.int64))

    def _visit(self, node, level: int, docs: np.ndarray) -> None:
        """Go on where the node of items and a node of documents may hold a pair that reaches the items' weakest line."""
        columns, (a, b), below = node
        bound = self.levels[level][columns[:, None], docs].sum(axis=0)
        docs = docs[(bound > 0) & (bound >= self.line[a:b].min())]
        if not len(docs):
            return
        if level:
            docs = (docs[:, None] * FAN + np.arange(FAN)).ravel()
            docs = docs[docs < self.levels[level - 1].shape[1]]
        for child in below or ([node] if level else []):
            self._visit(child, max(level - 1, 0), docs)
        if not below and not level:
            self._score(a, columns, docs)

    def _score(self, k: int, columns: np.ndarray, leaves: np.ndarray) -> None:
        """Exact scores of an item with the documents of some leaves."""
        spans = [np.arange(i, j) for i, j in zip(self.start[leaves].tolist(), self.start[leaves + 1].tolist())]
        at = np.concatenate(spans)
        mask = np.zeros(len(self.items.column), bool)
        mask[columns] = True
        at = at[mask[self.col[at]]]
        docs, into = np.unique(self.doc[at], return_inverse=True)
        score = np.bincount(into, self.impact[at], len(docs))
        some = score >= self.line[k]
        if not some.any():
            return
        old = self.best[k]
        score, docs = score[some], docs[some]
        score, ids, null = np.concatenate([old[0], score]), np.concatenate([old[1], self.id[docs]]), np.concatenate([old[2], self.null[docs]])
        by = np.lexsort((ids, null, -score))[: self.most]
        self.best[k] = score[by], ids[by], null[by]
        if len(by) == self.most:
            self.line[k] = max(self.line[k], score[by[-1]])

    def rows(self) -> pa.RecordBatch:
        """(item_id, doc_id, score) of what is kept."""
        item = np.repeat(np.array(self.items.ids, np.int64), [len(x[0]) for x in self.best])
        score, ids, null = (np.concatenate([x[k] for x in self.best]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score.astype(np.int64))], names=["item_id", "doc_id", "score"])


def _searched(docs: DataFrame, rows: list, lines: dict, most: int, count: int, total: int) -> DataFrame:
    """The best most documents of each task for each item of a block."""
    block = docs.sparkSession.sparkContext.broadcast((rows, lines))

    def run(batches):
        search = Search(Items(*block.value), most, count, total)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                search.add(b.slice(at, BATCH))
        yield search.rows()

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The most highest scores of each item, equal ones by doc_id, null last."""
    w = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def lexical_search(items: DataFrame, docs: DataFrame, most: int = TOP) -> DataFrame:
    """items (item_id, text), docs (doc_id, text) -> item_id, rank, doc_id, score: each item's best documents, all of them searched.

    A term's weight and a document's share follow from how many documents hold it and how long they are; all but the weight's
    logarithm is whole numbers. Each task builds trees over batches of its documents whose nodes hold the largest impact of each term,
    and meets them with the tree of items: a pair of nodes is left if no item below could reach its weakest kept score. Equal scores
    by doc_id, null last. Rows that share a doc_id are documents of their own, items that share an id are one. Null and empty texts
    have no terms. Items without a term that any document holds, empty tables: no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")), "item-terms")
    read = stored(document_terms(docs, wanted.select("term").distinct()), "document-terms")
    count, total = read.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * count + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = cut(wanted.join(held, "term").select("item_id", "term", weight.alias("w")))
    blocks = blocks_for(weighed.count(), BLOCK)
    found = None
    for k in range(blocks):
        # As many rows as a block holds; an item's terms stay together.
        rows = [tuple(r) for r in weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        if not rows:
            continue
        first = read.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0)
        seeds = ranked(_searched(first, rows, {}, most, count, total), most).where(F.col("rank") == most).select("item_id", "score").collect()
        own = cut(_searched(read, rows, dict(map(tuple, seeds)), most, count, total))
        found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return ranked(found, most)


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
