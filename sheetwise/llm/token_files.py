"""Token ids in Parquet list columns: dictionary or delta encoded, in row groups of a set size, with page indexes, read by column and by document."""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, shared_dir, table
from .common import pieces as by_bytes

#: The file of public_tokenizers whose ids are written, and the id that ends each document.
VOCABULARY, END = "byte_bpe_50k.json", 2
#: Bytes and rows of text that are encoded at once (a batch finds its distinct words, so short texts are taken together), words that a task remembers and their mean bytes, at most.
BYTES, ROWS, KNOWN, WORD = 8_000_000, 100_000, 500_000, 64
#: Bytes of a row group and of a page, and rows of a row group, at most.
GROUP, PAGE, GROUP_ROWS = 32 << 20, 1 << 20, 100_000

#: White space and letters of Latin-1, as classes.
_WHITE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What may not be cut at blanks: a blank before white space, the mark used for cutting, what looks like an added token.
_WHOLE = rf" [{_WHITE}]|<\||\x01"
#: A line's end between ink, and signs after a letter and before a blank, are pieces of their own: they are set off by blanks and marks that there were none.
_MARK = "\x01"
_LINE, _LINES = rf"([^{_WHITE}])\n([^{_WHITE}])", "\\1 \x01\n \x01\\2"
_SIGN, _APART = rf"([{_LETTER}])([!-/:-@\[-`{{-~]+) ", "\\1 \x01\\2 "


class Encoder:
    """A byte-level BPE tokenizer that encodes batches of texts by their distinct words.

    The byte-level pattern always breaks before a blank that ink follows, so a text's ids are those of its words, each with the
    blank before it. The library encodes words that are not known yet; texts that can't be cut so are encoded whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(spec)
        self.model = self.own.model
        # Byte-level letters: printable bytes of Latin-1 stand for themselves, the others for the letters from 256 on. Line's ends part words here.
        shown = {b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173}
        self.letters = np.arange(256, dtype="<u2")
        self.letters[[b for b in range(256) if b not in shown]] = 256 + np.arange(256 - len(shown))
        self.letters[10] = 10
        #: What is known: words, the number of their ids, these one after the other, and how often each word was met.
        self.words, self.size, self.ids, self.met = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each text's ids), by the library, a text at a time."""
        return _joined(self.own.encode(t, add_special_tokens=False).ids for t in texts)

    def spelt(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As whole, for words: marked ones as they are, others with a blank before them. Letters alone are one piece, which the model splits."""
        plain = pc.match_substring_regex(words, f"^{_MARK}?[{_LETTER}]+$").to_numpy(zero_copy_only=False)
        units = pc.replace_substring_regex(pc.replace_substring_regex(words, "^", " "), f"^ {_MARK}", "")
        joined = "\n".join(units.filter(pa.array(plain)).to_pylist()).encode()
        shown = self.letters[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
        split = self.model.tokenize
        some, n = _joined([t.id for t in split(x)] for x in (shown.split("\n") if plain.any() else ()))
        rest, m = self.whole(units.filter(pa.array(~plain)).to_pylist())
        size = np.zeros(len(words), np.int32)
        size[plain], size[~plain] = n, m
        ids, of = np.zeros(size.sum(), np.uint32), np.repeat(plain, size)
        ids[of], ids[~of] = some, rest
        return ids, size

    def batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each text's ids); null as empty. end: an id after each text."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        # A text's first word has no blank before it.
        cut = pc.binary_join_element_wise(_MARK, pc.if_else(pa.array(whole), "", texts), "")
        words = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring_regex(cut, _LINE, _LINES), _SIGN, _APART), " ")
        ends = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.slice(ends[0], ends[-1] - ends[0])
        ends -= ends[0]
        n, coded = len(self.words), pa.concat_arrays([self.words, flat]).dictionary_encode()
        codes, distinct = coded.indices.to_numpy()[n:], coded.dictionary
        ids, size = self.spelt(distinct.slice(n))
        self.words, self.size, self.ids = distinct, np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        self.met = np.bincount(codes, minlength=len(distinct)) + np.pad(self.met, (0, len(size)))
        ids, size = [self.ids], [self.size]
        odd = np.flatnonzero(whole)
        if len(odd):
            more = self.whole(texts.take(pa.array(odd)).to_pylist())
            codes = codes.copy()
            codes[ends[odd]] = len(distinct) + np.arange(len(odd))
            ids.append(more[0])
            size.append(more[1])
        if end is not None:
            codes, ends = np.insert(codes, ends[1:], len(distinct) + len(odd)), ends + np.arange(len(ends))
            ids.append(np.array([end], np.uint32))
            size.append(np.ones(1, np.int32))
        ids, size = np.concatenate(ids), np.concatenate(size)
        each = size[codes]
        reach = np.concatenate([[0], np.cumsum(each)])
        start = np.cumsum(size) - size
        out = ids[np.repeat(start[codes] - reach[:-1], each) + np.arange(reach[-1])]
        self._forget()
        return out, reach[ends[1:]] - reach[ends[:-1]]

    def _forget(self) -> None:
        """If too much is known, words that were met once, or are long, go."""
        if len(self.words) <= KNOWN and self.words.nbytes <= KNOWN * WORD:
            return
        keep = (self.met > 1) & (pc.binary_length(self.words).to_numpy() <= WORD)
        keep &= np.cumsum(keep) <= KNOWN // 2
        self.words, self.ids = self.words.filter(pa.array(keep)), self.ids[np.repeat(keep, self.size)]
        self.size, self.met = self.size[keep], np.zeros(keep.sum(), np.int64)


def _joined(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and the number of each."""
    ids, n = array("I"), array("i")
    for own in lists:
        ids.fromlist(own)
        n.append(len(own))
    return np.array(ids, np.uint32), np.array(n, np.int32)


def _encoder(shared: dict) -> Encoder:
    """The encoder of a broadcast vocabulary, kept with it, so that a worker's tasks share what it knows."""
    if "built" not in shared:
        shared["built"] = Encoder(shared["spec"])
    return shared["built"]


def vocabulary(name: str = VOCABULARY) -> str:
    """The text of a vocabulary file of public_tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encode_ordered(docs: DataFrame, spec: str, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> doc_id, part, at, n, ids: each text's ids and the end id, in ascending doc_id order from part to part.

    at counts the ids before a document in its part, n its own, the end id included. Null doc_id comes first; documents of one id keep the order of the input. Null
    and empty texts: the end id alone. Long texts are encoded whole, repeated rows one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"spec": spec})

    def run(batches):
        from pyspark import TaskContext

        enc, part, at = _encoder(shared.value), TaskContext.get().partitionId(), 0
        for b in by_bytes(batches, 1, BYTES, ROWS):
            ids, n = enc.batch(b.column(1).cast(pa.string()), end)
            offsets = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(n.astype(np.int32)), lists], names=["doc_id", "part", "at", "n", "ids"])
            at += int(offsets[-1])

    # Places of rows part those that share an id, so that one id with very many rows is dealt out too.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_at"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_at")]
    ranged = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return ranged.mapInArrow(run, f"doc_id {kind}, part int, at long, n int, ids array<int>")


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", group: int = GROUP, rows: int = GROUP_ROWS, page: int = PAGE) -> None:
    """tokens as Parquet files: ids dictionary or delta encoded, row groups of group bytes and rows rows at most, pages with column indexes.

    Columns besides ids are delta encoded in both cases, as they ascend. Spark's committer writes, so a task that is run again leaves one file.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    w = tokens.write.option("compression", "snappy").option("parquet.writer.version", "v2").option("parquet.block.size", group).option("parquet.block.row.count.limit", rows)
    w = w.option("parquet.page.size", page).option("parquet.page.row.count.limit", 1000).option("parquet.enable.dictionary", "false")
    w.option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower()).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True, least: int | None = None, most: int | None = None) -> DataFrame:
    """doc_id, start and, if asked for, ids of the documents from least to most; start counts the ids before a document in all files.

    Only the columns asked for are read, and of row groups and pages those whose indexes admit the bounds. The first ids of the parts
    come from the lengths of the parts, one row each.
    """
    files = spark.read.parquet(path)
    ends = files.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n"))
    base = ends.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    some = files if least is None else files.where(F.col("doc_id") >= least)
    some = some if most is None else some.where(F.col("doc_id") <= most)
    # As many rows as partitions were written, which is a setting.
    return some.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), *["ids"] * ids)


def token_digests(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, start, ids) -> doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back and digested. The files stay in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(encode_ordered(table(spark, sf_dir, "documents"), vocabulary()), path)
    return token_digests(read_tokens(spark, path))
