"""Toxicity by the nearest labelled examples in exact TF-IDF cosine, found in a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, pieces, table

#: Labelled examples of each class in the index, and held back from it for calibration, at most, and the bytes of text that an
#: example has at most: what is gathered and broadcast is bounded by these. Longer labelled texts are scored, not learnt from.
EXAMPLES, CALIBRATION = 2500, 500
EXAMPLE_BYTES = 20_000
#: Terms that fewer examples hold say nothing about others.
LEAST_EXAMPLES = 2
#: Chi-square with one degree that a term's examples must reach against the labels; others only blur cosines.
TELLING = 10.8
#: Voters; examples in a block of the index; blocks that are searched before any is skipped.
VOTERS, BLOCK, FIRST = 30, 64, 6
#: Words of one batch that a task scores at a time are bounded by this many bytes of text.
BYTES = 2_000_000
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """The lower-cased runs of letters of a text, counted."""
    return Counter(_WORDS.findall((text or "").lower()))


class Index:
    """Examples as an inverted index: for every term, its examples by block, and its largest weight in each block."""

    def __init__(self, words: list[str], idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        """vectors: terms, by their place in words, and weights of each example, of length 1."""
        self.words, self.idf = {w: i for i, w in enumerate(words)}, np.asarray(idf, float)
        # Examples of one language, and of like words, come into the same blocks: by their heaviest common terms.
        first = [min(k[np.argsort(self.idf[k])[:4]].tolist(), default=0) if len(k) else 0 for k, _ in vectors]
        order = np.lexsort((np.arange(len(vectors)), labels, first))
        self.order, self.labels = order, np.asarray(labels)[order]
        term = np.concatenate([vectors[o][0] for o in order] or [np.empty(0, int)])
        example = np.repeat(np.arange(len(order)), [len(vectors[o][0]) for o in order])
        weight = np.concatenate([vectors[o][1] for o in order] or [np.empty(0)])
        self.blocks = max(1, -(-len(order) // BLOCK))
        by = np.lexsort((example, term))
        self.example, self.weight = example[by].astype(np.int32), weight[by]
        cell = term[by] * self.blocks + self.example // BLOCK
        self.start = np.searchsorted(cell, np.arange(len(self.words) * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros(len(self.words) * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(self.words), self.blocks)

    def vector(self, c: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Known terms in order, and their weights (1 + ln tf) * idf, scaled to length 1."""
        k = np.array([self.words[w] for w in c if w in self.words], int)
        v = (1 + np.log(np.array([n for w, n in c.items() if w in self.words], float))) * self.idf[k]
        keep = v > 0
        k, v = k[keep], v[keep]
        by = np.argsort(k)
        k, v = k[by], v[by]
        return k, v / (np.sqrt((v * v).sum()) or 1.0)

    @classmethod
    def of(cls, state: dict) -> Index:
        """An index from vars(index), which any task can unpickle."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def _add(self, scores: np.ndarray, k: np.ndarray, v: np.ndarray, blocks: np.ndarray) -> None:
        cell = (k[:, None] * self.blocks + blocks[None]).ravel()
        lo, n = self.start[cell], self.start[cell + 1] - self.start[cell]
        some = n > 0
        lo, n, w = lo[some], n[some], np.repeat(v, len(blocks))[some]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        scores += np.bincount(self.example[at], weights=np.repeat(w, n) * self.weight[at], minlength=len(scores))

    def nearest(self, k: np.ndarray, v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The top examples by exact cosine, and the cosines; ties to the earlier. Blocks whose bound is too low are skipped."""
        n = len(self.labels)
        if not len(k) or not n:
            return np.empty(0, int), np.empty(0)
        bound = v @ self.most[k]
        order = np.argsort(-bound, kind="stable")
        scores = np.zeros(n)
        self._add(scores, k, v, order[:FIRST])
        line = np.partition(scores, n - top)[n - top] if n > top else 0.0
        rest = order[FIRST:][bound[order[FIRST:]] >= line - 1e-12]
        if len(rest):
            self._add(scores, k, v, rest)
        near = np.argpartition(-scores, min(top, n - 1))[: top + 1] if n > top else np.arange(n)
        line = np.sort(scores[near])[::-1][: top][-1]
        near = np.flatnonzero(scores >= max(line, 1e-12))
        near = near[np.lexsort((near, -scores[near]))][:top]
        return near, scores[near]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of the toxic among the voters, each weighing the square of its cosine; the examples' own share without any."""
        w = cosine * cosine
        prior = self.labels.mean() if len(self.labels) else 0.0
        return float(((w * self.labels[near]).sum() + 1e-6 * prior) / (w.sum() + 1e-6))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A logistic curve through votes and labels, by Newton's method with a weak pull to 0."""
    a = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-3 * a
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, g), -5, 5)
    return float(a[0]), float(a[1])


def _counted(batches):
    """(id, label, held, text) -> a row for each term of a text, with its count."""
    for batch in pieces(batches, 3, BYTES):
        out = []
        for i, y, h, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
            out += [(i, y, h, w, n) for w, n in terms(t).items()]
        ids, labels, held, words, counts = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(held, pa.bool_()), pa.array(words, pa.string()), pa.array(counts, pa.int32())], names=["id", "label", "held", "term", "tf"]
        )


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Index, tuple[float, float], np.ndarray] | None:
    """An index, its calibration and the examples' ids, from docs (id, text) and labels (id, label).

    Of each class, the EXAMPLES + CALIBRATION labelled documents of smallest id hash among those of EXAMPLE_BYTES at most, so that the same come
    out on every run; they are chosen by id alone, and only their texts are read. Terms are counted, rated against the labels and weighed as
    tables; weights of the terms that tell labels apart are all that reaches the driver. The classes are weighed back to their own shares
    when votes are calibrated.
    """
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= EXAMPLE_BYTES)
    rows = cut(labels.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and id is not null").join(short.select("id").distinct(), "id", "left_semi").distinct())
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    chosen = None
    for y in sorted(shares):
        own = rows.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES + CALIBRATION)
        # Every sixth row calibrates, however few there are.
        nth = F.row_number().over(W.orderBy(F.crc32(F.col("id").cast("string").cast("binary")), "id")) - 1
        own = own.withColumn("held", (nth > 0) & (nth % ((EXAMPLES + CALIBRATION) // CALIBRATION) == 0))
        chosen = own if chosen is None else chosen.union(own)
    # Twice EXAMPLES + CALIBRATION ids at most; of several texts of an id, the first.
    chosen = cut(chosen)
    texts = short.join(F.broadcast(chosen), "id").groupBy("id", "label", "held").agg(F.min("text").alias("text"))
    counted = cut(texts.mapInArrow(_counted, "id long, label int, held boolean, term string, tf int"))
    examples = chosen.orderBy("label", F.crc32(F.col("id").cast("string").cast("binary")), "id").toPandas()
    train = examples[~examples["held"].astype(bool)].reset_index(drop=True)
    n, t = len(train), int(train["label"].sum())
    seen = counted.where("not held").groupBy("term").agg(F.count("*").alias("df"), F.sum("label").alias("toxic")).where(F.col("df") >= LEAST_EXAMPLES)
    # Whether a term's toxic examples differ in number from its share, by more than chance.
    expected = F.col("df") * (t / n)
    spread = expected * (1 - t / n) * (n - F.col("df")) / max(1, n - 1)
    telling = seen.where((spread <= 0) | (F.pow(F.col("toxic") - expected, 2) >= TELLING * spread))
    # As many rows as terms of the examples; numbers stand for them, so that no weight carries its word to the driver.
    rated = (seen if telling.isEmpty() else telling).select("term", F.log((n + 1) / (F.col("df") + 1)).alias("idf"))
    vocabulary = cut(rated.withColumn("k", (F.row_number().over(W.orderBy("term")) - 1).cast("int")))
    weight = ((1 + F.log("tf")) * F.col("idf")).alias("w")
    weighed = counted.join(vocabulary, "term").select("id", "k", weight).where("w > 0").toPandas()
    known = vocabulary.orderBy("k").select("term", "idf").toPandas()
    none, vectors = (np.empty(0, int), np.empty(0)), {}
    for i, own in weighed.groupby("id"):
        k, v = own["k"].to_numpy(), own["w"].to_numpy()
        by = np.argsort(k)
        vectors[i] = (k[by], v[by] / np.sqrt((v * v).sum()))
    index = Index(known["term"].tolist(), known["idf"].to_numpy(), [vectors.get(i, none) for i in train["id"]], train["label"].to_numpy())
    held = examples[examples["held"].astype(bool)]
    cal = held if len(held) else train
    votes = np.array([index.vote(*index.nearest(*vectors.get(i, none), VOTERS)) for i in cal["id"]])
    y = cal["label"].to_numpy()
    weight = np.array([shares[c] / max(1, (y == c).sum()) for c in y])
    curve = _calibrate(votes, y, weight * len(y) / weight.sum())
    return index, curve, train["id"].to_numpy()[index.order]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (id, text) and labels (id, label 0 or 1; others are ignored) -> id, score, votes and evidence: the ids and cosines of the nearest labelled examples.

    A text's VOTERS nearest examples vote with the squares of their cosines; a logistic curve, fitted on labelled rows held
    back from the index, turns the vote into a probability. A labelled document is never its own evidence; copies are.
    The space of the cosines holds the terms that tell labels apart; in it they are exact, and equal ones are settled by the index's order.
    Null and empty texts, and texts without known terms, get the score of a vote at the examples' own share. No labelled
    rows: score 0, no evidence. Repeated rows score alike. Texts are taken whole. Only id, text and label are read, so other columns can
    have any name. Empty input: no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    model = fit(named, labels)
    shared = spark.sparkContext.broadcast(model and (vars(model[0]), *model[1:]))

    def score(batches):
        model = shared.value
        index = model and Index.of(model[0])
        for batch in pieces(batches, 1, BYTES):
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if model is None:
                    out.append((i, 0.0, 0.0, []))
                    continue
                _, (a, b), names = model
                near, cos = index.nearest(*index.vector(terms(t.as_py())), VOTERS + 1)
                if i is not None:
                    other = names[near] != i
                    near, cos = near[other], cos[other]
                near, cos = near[:VOTERS], cos[:VOTERS]
                v = index.vote(near, cos)
                out.append((i, float(1 / (1 + np.exp(-(a * v + b)))), v, [{"id": int(n), "cosine": float(c)} for n, c in zip(names[near[:3]], cos)]))
            ids, scores, votes, seen = zip(*out)
            kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores), pa.array(votes), pa.array(seen, kind)], names=["id", "score", "vote", "evidence"])

    return named.mapInArrow(score, "id long, score double, vote double, evidence array<struct<id:long,cosine:double>>")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_knn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where(~held_out(F.col("id")))
    scored = toxicity(docs, labels)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
