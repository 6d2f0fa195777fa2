"""SentencePiece encoding and decoding as shortest paths through a weighted transducer."""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces as by_bytes
from .common import table

#: Where the vocabulary is; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units (a word with the blanks before it) that a task remembers, and the longest of them.
KNOWN, LONGEST = 600_000, 48
BYTES = 2_000_000


def compile_model(path: str) -> dict:
    """The transducer's parts as plain data: normaliser flags, pieces with their costs, byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only identity normalisers of unigram and BPE models are compiled")
    kinds = pb.ModelProto.SentencePiece
    own = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
    return {
        "bpe": m.trainer_spec.model_type == 2, "prefix": m.normalizer_spec.add_dummy_prefix, "squeeze": m.normalizer_spec.remove_extra_whitespaces,
        "ids": own, "score": [p.score for p in m.pieces], "longest": max(map(len, own)), "unknown": next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN),
        "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE},
        "units": not any(SPACE in p.lstrip(SPACE) for p in own),
        "out": [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type in (kinds.CONTROL,) else p.piece.encode() for p in m.pieces],
    }


class _Known(dict):
    """Encoded units by text; a unit that is asked for and not known is encoded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit):
        ids = self.make(unit)
        if len(unit) <= LONGEST:
            if len(self) > KNOWN:
                self.clear()
            self[unit] = ids
        return ids


class Transducer:
    """The composition of normaliser, pieces and byte fallback, over the tropical semiring.

    Its arcs read the raw text: the normaliser's arc from a blank to U+2581 is composed into the tree of pieces, so that both
    lead on alike, and its initial arc puts a blank before the text. To a place in the text an arc leads over every piece
    that the text up to there ends with, or over a character without a piece, as its bytes. Every place keeps the last piece of its cheapest path, which the
    weight of the next arc depends on: in a unigram model that is the piece's negative score; in a BPE model it is 0 if merging the joint
    text of the two pieces gives just these two, else infinite. As merging a beginning of a text gives one result, just one path
    to each place is finite then. No arc crosses two characters that no piece holds side by side, so that texts are cut there; words that
    begin alike share the states of their beginnings. Ids are 32-bit little-endian bytes here.
    """

    def __init__(self, model: dict):
        self.m, self.pairs = model, {}
        self.known = _Known(self._unit)
        self.normaliser = {" ": SPACE}
        #: The pieces' symbols from the last to the first, composed with the normaliser, as a tree; a node's own piece is under the empty string.
        self.tree: dict = {}
        for p, k in model["ids"].items():
            node = self.tree
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = k
        self._compose(self.tree)
        back = {written: read for read, written in self.normaliser.items()}
        plain = lambda c: back.get(c, c)
        #: Characters that some piece holds side by side.
        self.joined = {plain(x) + plain(y) for p in model["ids"] for x, y in zip(p, p[1:])}
        #: Beginnings of units, and the cheapest way to their ends: its cost, its last piece, and where that begins.
        self.begun: dict = {}
        self.text = {k: p for p, k in model["ids"].items()}
        self.is_byte = np.zeros(len(model["score"]), bool)
        self.is_byte[list(model["bytes"].values())] = True
        # Ten below the worst score, as unknown characters cost.
        self.unknown = 0.0 if model["bpe"] else 10 - min(model["score"])

    def _compose(self, node: dict) -> None:
        for c, below in list(node.items()):
            if c:
                self._compose(below)
        for read, written in self.normaliser.items():
            if written in node:
                node[read] = node[written]

    def normal(self, text: str) -> str:
        """What the normaliser's stateful arcs leave to read: blanks at the ends and runs of blanks, if squeezed, and the initial blank."""
        text = text.replace(SPACE, " ")
        if self.m["squeeze"]:
            text = re.sub(" +", " ", text.strip(" "))
        return (" " if self.m["prefix"] else "") + text if text else ""

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored pair first, the leftmost of equals. For short texts."""
        ids, score, parts, never = self.m["ids"], self.m["score"], list(text), float("-inf")
        rate = lambda x: score[ids[x]] if x in ids else never
        pairs = [rate(a + b) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == never:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rate(parts[k - 1] + parts[k])
            if k < len(pairs):
                pairs[k] = rate(parts[k] + parts[k + 1])
        return parts

    def weight(self, a: int, b: int) -> float:
        """The weight of reading piece b after piece a, or at a start if a is -1; kept for BPE models."""
        if not self.m["bpe"]:
            return -self.m["score"][b]
        if len(self.pairs) > KNOWN:
            self.pairs.clear()
        x, y = self.text.get(a, ""), self.text[b]
        w = self.pairs[(a << 24) + b] = 0.0 if self.merged(x + y) == ([x, y] if x else [y]) else float("inf")
        return w

    def _fallback(self, c: str) -> list[int]:
        by = self.m["bytes"]
        return [by[x] for x in c.encode("utf-8", "surrogatepass")] if by else [self.m["unknown"]]

    def path(self, unit: str) -> list[int]:
        """The shortest path over one unit, by relaxing the arcs into each place from left to right."""
        n, tree, known, begun = len(unit), self.tree, self.pairs, self.begun
        least = 0.0 if self.m["bpe"] else float("-inf")
        short = n <= LONGEST
        if len(begun) > KNOWN:
            begun.clear()
        best = [(0.0, -1, 0)]
        for j in range(1, n + 1):
            state = begun.get(unit[:j]) if short else None
            if state is None:
                i, node, arcs = j, tree.get(unit[j - 1]), []
                alone = node is not None and "" in node
                while node is not None:
                    i -= 1
                    if "" in node:
                        arcs.append((i, node[""]))
                    node = node.get(unit[i - 1]) if i else None
                # A character without a piece is read as its bytes: no merge crosses it.
                state = (float("inf"), -1, j - 1) if alone else (best[j - 1][0] + self.unknown, -1, j - 1)
                for i, k in reversed(arcs):
                    c, a, _ = best[i]
                    # No weight is below the least, so that nothing is won where the way is as short already.
                    if c + least < state[0]:
                        w = known.get((a << 24) + k)
                        if w is None:
                            w = self.weight(a, k)
                        if c + w < state[0]:
                            state = (c + w, k, i)
                if short:
                    begun[unit[:j]] = state
            best.append(state)
        out, at = [], n
        while at:
            _, k, i = best[at]
            out += [k] if k >= 0 else self._fallback(unit[i:at])[::-1]
            at = i
        return out[::-1]

    def cuts(self, unit: str) -> list[str]:
        """The parts of a unit between characters that no piece holds side by side."""
        at, out, joined = 0, [], self.joined
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in joined:
                out.append(unit[at:k])
                at = k
        return [*out, unit[at:]]

    def _unit(self, unit: str) -> bytes:
        parts = self.cuts(unit)
        if len(parts) == 1:
            return array("i", self.path(unit)).tobytes()
        known = self.known
        return b"".join([known[p] for p in parts])

    def encode(self, text: str | None) -> bytes:
        text = self.normal(text or "")
        if not text:
            return b""
        if not self.m["units"]:
            return self._unit(text)
        known = self.known
        if text[0] == " " and "  " not in text:
            return b"".join([known[" " + w] for w in text[1:].split(" ")])
        return b"".join([known[u] for u in re.findall(" +[^ ]*|[^ ]+", text)])

    def decode(self, ids) -> str:
        out = self.m["out"]
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.m["prefix"] and text[:1] == " " else text


def _transducer(model: dict) -> Transducer:
    """The transducer of a broadcast model, kept with it, so that a worker's tasks share what it knows."""
    if "_built" not in model:
        model["_built"] = Transducer(model)
    return model["_built"]


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(compile_model(path))


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with a text column -> with ids array<int>. Null text: null; empty text: no ids.

    Rows, repeated or not, are encoded one by one, whole; of paths that cost the same, the one whose last piece begins first wins. A column named ids is replaced, other columns stay. Empty input: no rows.
    """
    model = _shared(docs.sparkSession, path)
    docs = docs.drop("ids")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        t = _transducer(model.value)
        for b in by_bytes(batches, at, BYTES):
            ids = [None if x is None else t.encode(x) for x in b.column(at).to_pylist()]
            ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)], dtype=np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(x or b"" for x in ids))])
            got = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in ids]))
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, ids array<int>")


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows with an ids column -> with text: what the ids spell; null for null, ids outside the vocabulary raise.

    A column named text is replaced, other columns stay. Empty input: no rows.
    """
    model = _shared(rows.sparkSession, path)
    rows = rows.drop("text")
    names, at = rows.columns, rows.columns.index("ids")

    def run(batches):
        t = _transducer(model.value)
        for b in by_bytes(batches, at, BYTES):
            text = [None if x is None else t.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, text string")


def round_trips(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs (id, text) -> id, n_tokens, n_bytes (byte-fallback tokens), ids_sha256 (little-endian 32-bit ids), text_sha256 (of the decoded text), round_trip.

    A text that holds U+2581 comes back with a blank instead; every other text comes back as it was. Null: as empty. Repeated rows give the same result each. Only id and text are read, so other
    columns can have any name. Empty input: no rows.
    """
    model = _shared(docs.sparkSession, path)

    def run(batches):
        t = _transducer(model.value)
        for b in by_bytes(batches, 1, BYTES):
            ids, n, nb, digests, texts, same = [], [], [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = t.encode(x)
                got = np.frombuffer(raw, "<i4")
                back = t.decode(got.tolist())
                ids.append(i)
                n.append(len(got))
                nb.append(int(t.is_byte[got].sum()))
                digests.append(hashlib.sha256(raw).hexdigest())
                texts.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == (x or ""))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(nb, pa.int64()), pa.array(digests), pa.array(texts), pa.array(same)], names=["id", "n_tokens", "n_bytes", "ids_sha256", "text_sha256", "round_trip"])

    named = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "id long, n_tokens long, n_bytes long, ids_sha256 string, text_sha256 string, round_trip boolean")


def op8_transducer_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return round_trips(docs).withColumnRenamed("id", "doc_id")
