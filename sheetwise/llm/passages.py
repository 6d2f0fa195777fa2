"""Passages of words that documents share, from the interval trees of repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table
from .repeats import _key, _mixed, _pick, _powers, _R, _rolling, _sliding_min, _text_hash, _U, merged, repeated_stretches, RUNS, with_stretches

#: Words of a passage: over 50.
WORDS = 51
#: Bytes of a word's code.
CODE = 4
#: Words of the grams whose least hash names a window.
GRAM_WORDS = 8
#: Bytes of texts that are coded together, about.
BATCH = 500_000

_INK = np.ones(256, bool)
_INK[[0x20, *range(0x09, 0x0E)]] = False


def codes(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 28-bit code of each word `[^\\x20\\x09-\\x0D]+` of joined UTF-8 texts, from a hash of it, and how many words end up to each text's end."""
    ink = np.zeros(len(b) + 2, bool)
    ink[1:-1] = _INK[b]
    new = ink[1:] & ~ink[:-1]
    over = ink[1:] != ink[:-1]
    inner = ends[(ends > 0) & (ends < len(b))]
    cut = inner[ink[inner] & ink[inner + 1]]  # a text ends in a word and the next begins with one
    new[cut] = True
    x, y = np.flatnonzero(new), np.flatnonzero(over & ~ink[1:])
    if len(cut):
        y = np.sort(np.concatenate([y, np.unique(cut)]))
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)], out=sums[1:])
    return _mixed((sums[y] - sums[x]) * down[x]) >> _U(36), np.searchsorted(x, ends)


def _raw(texts: pa.Array) -> list:
    return [t.as_buffer() if t.is_valid else b"" for t in texts]


def segments(raw: list, words: int = WORDS) -> list[list[tuple[int, bytes]]]:
    """(first word, codes as bytes) for each text: the stretches whose strings of so many words are all there for the first time.

    A code's first byte alone has its high bit set, so that strings of codes are equal only where whole words are.
    """
    c, ends = codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw], dtype=np.int64))
    out: list[list[tuple[int, bytes]]] = [[] for _ in raw]
    if len(c) < words:
        return out
    coded = np.stack([c & _U(127) | _U(128), *((c >> _U(k)) & _U(127) for k in (7, 14, 21))], axis=1).astype(np.uint8)
    begins = np.concatenate([[0], ends[:-1]])
    h = _rolling(c, words)
    own = np.repeat(np.arange(len(raw)), ends - begins)
    whole = own[: len(h)] == own[words - 1 :]
    apart = h ^ _mixed(own[: len(h)].astype(_U) * _R)
    told = np.sort(apart[whole])
    again = told[1:][told[1:] == told[:-1]]
    some = set(own[: len(h)][whole & np.isin(apart, again)].tolist()) if len(again) else ()
    for k, (x, y) in enumerate(zip(begins.tolist(), ends.tolist())):
        if y - x < words:
            continue
        if k not in some:
            out[k].append((0, coded[x:y].tobytes()))
            continue
        new = np.zeros(y - x - words + 3, bool)
        new[np.unique(h[x : y - words + 1], return_index=True)[1] + 1] = True
        edges = np.flatnonzero(new[1:] != new[:-1]).tolist()
        out[k] = [(f, coded[x + f : x + g + words - 1].tobytes()) for f, g in zip(edges[::2], edges[1::2])]
    return out


def _coded(words: int):
    """(id, text) -> (id, codes), a row for each segment."""

    def make(batches):
        for batch in pieces(batches, 1, BATCH):
            ids, texts = [], []
            for i, own in zip(batch.column(0).to_pylist(), segments(_raw(batch.column(1)), words)):
                ids += [i] * len(own)
                texts += [c for _, c in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])

    return make


def _named(words: int):
    """(id, text) -> the runs of each segment, as repeats names them, but for windows that begin with a word."""

    def make(batches):
        for batch in pieces(batches, 1, BATCH):
            ids, texts = [], []
            for i, own in zip(batch.column(0).to_pylist(), segments(_raw(batch.column(1)), words)):
                ids += [i] * len(own)
                texts += [c for _, c in own]
            if not ids:
                continue
            raw = b"".join(texts)
            c, size = np.frombuffer(raw, np.uint32), np.array([len(t) // CODE for t in texts])
            ends = np.cumsum(size)
            begins, own = ends - size, np.repeat(np.arange(len(size)), size)
            m = _sliding_min(_rolling(c, GRAM_WORDS), words - GRAM_WORDS + 1)
            at, n = own[: len(m)], len(m)
            lo = np.flatnonzero((at == own[words - 1 :]) & np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1])]))
            k = at[lo]
            hi = np.where(np.append(k[1:], -1) == k, np.append(lo[1:], n) - 1, ends[k] - words)
            # No window repeats within a segment.
            places = ((lo - begins[k]) * CODE << 32) + ((hi - lo) * CODE << 1)
            view = memoryview(raw)
            digests = [xxhash.xxh3_64_intdigest(view[x * CODE : (y + words) * CODE]) for x, y in zip(lo.tolist(), hi.tolist())]
            docs = np.array([_text_hash(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (np.array(ids, np.int64)[k], docs[k], m[lo].view(np.int64), places, np.array(digests, _U).view(np.int64)))], names=["id", "doc", "name", "place", "digest"])

    return make


def _with_words(words: int):
    """(id, text, stretches, stretches of codes) -> what is left of each document, and its words in shared passages."""

    def make(batches):
        for batch in pieces(batches, 1, BATCH):
            shared = []
            lists = [dict(m or ()) for m in batch.column(3).to_pylist()]
            asked = [t if m else b"" for t, m in zip(_raw(batch.column(1)), lists)]
            for own, m in zip(segments(asked, words), lists):
                cover = []
                for first, c in own:
                    # Stretches may begin or end within a code.
                    found = ((first - s["x"] // -CODE, first + s["y"] // CODE) for s in m.get(_text_hash(c), ()))
                    cover += [(x, y) for x, y in found if y - x >= words]
                shared.append(sum(y - x for x, y in merged(cover)))
            left = pa.Table.from_batches(_pick([batch.select([0, 1, 2])])).combine_chunks()
            yield from left.append_column("n_shared_words", pa.array(shared, pa.int64())).to_batches()

    return make


def without_repeats_and_shared_words(docs: DataFrame, width: int = 400, words: int = WORDS) -> DataFrame:
    """docs (id, text) -> the columns of without_repeats, and n_shared_words.

    n_shared_words: words that lie in a string of so many words that another row has too, whatever blanks part its words; where
    a text has a string more than once, its first place counts. Words are compared by codes of 28 bits: two strings that
    differ in one word pass as equal once in 270 million. Texts with fewer words, or null: 0.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    keyed = docs.select(_key(F.col("id")).alias("id"), "text")
    coded, found = keyed.mapInArrow(_coded(words), "id long, text binary"), keyed.mapInArrow(_named(words), RUNS)
    cover = repeated_stretches(coded, CODE * words, found=found).groupBy(F.col("id").alias("k"), "doc").agg(F.collect_set(F.struct("x", "y")).alias("c"))
    lists = cover.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("doc", "c"))).alias("s"))
    joined = with_stretches(docs, width).join(lists.hint("shuffle_hash"), "k", "left").select("id", "text", "m", "s")
    return joined.mapInArrow(_with_words(words), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long")


def op5_with_shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that start more than once, and their words in passages of over 50 words that other documents hold too."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return without_repeats_and_shared_words(docs).withColumnRenamed("id", "doc_id")
