"""Token files, spelling variants and lexical search against the library, brute force and odd rows."""

import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import lexical, oracles, queries, secrets, spelling, stages, token_files

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, N string, part string, word string, term string"
TEXTS = [
    None, "", " ", "a", "word, word. Word!  two  blanks\n\nlines \n and more\ttabs", "éàü straße naïve × 12,5 don't 'tis we'll", "漢字 and emoji 😀 ok\x01x\x00y <|endoftext|> end",
    "x\n y.\nZ a.\n b;c (d) [e], f... g", "tail. ", " lead", "Ab1 cd,ef. gh", "a" * 20_000, "word " * 5000, "ends.\n", "\n", "a  b. c\x1cd. e",
]


def rows(spark, texts):
    return spark.createDataFrame([(k if k else None, t, "n", "p", "w", "t") for k, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    texts = TEXTS + TEXTS[4:6]
    token_files.write_tokens(token_files.encode_ordered(rows(spark, texts), token_files.vocabulary()), str(tmp_path / "t"), encoding, rows=3)
    got = {r["doc_id"]: (r["start"], r["ids"]) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    at = 0
    for k, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[k or None] == (at, ids), t
        at += len(ids)
    some = token_files.read_tokens(spark, str(tmp_path / "t"), ids=False, least=3, most=5)
    assert some.columns == ["doc_id", "start"] and {r["doc_id"]: r["start"] for r in some.collect()} == {k: got[k][0] for k in (3, 4, 5)}
    d = {r["doc_id"]: r for r in token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()}
    assert all(d[k]["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(v)}I", *v)) and d[k]["n_tokens"] == len(v) for k, (_, v) in got.items())


def test_token_files_read_some(spark, tmp_path):
    import pyarrow.parquet as pq

    texts = [f"text {k} of some words" for k in range(40)]
    token_files.write_tokens(token_files.encode_ordered(rows(spark, texts).coalesce(1), token_files.vocabulary()), str(tmp_path / "t"), rows=5)
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "t").glob("part-*")]
    assert sum(m.num_rows for m in found) == 40 and all(m.row_group(g).num_rows <= 5 for m in found for g in range(m.num_row_groups))
    columns = {c.path_in_schema: c for m in found[:1] for c in (m.row_group(0).column(k) for k in range(m.num_columns))}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in columns["at"].encodings
    assert all(c.has_offset_index for c in columns.values())
    assert token_files.encode_ordered(rows(spark, []), token_files.vocabulary()).count() == 0


def test_known_words_take_no_call_each():
    """Words are looked up all together: a batch of known words makes as few Python calls as one of a single word."""
    import sys

    import pyarrow as pa

    rng = random.Random(3)
    texts = pa.array([" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(100)) + "." for _ in range(50)])
    enc, calls = token_files.Encoder(token_files.vocabulary()), Counter()
    first = enc.batch(texts)
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    again = enc.batch(texts)
    sys.setprofile(None)
    assert all((x == y).all() for x, y in zip(first, again))
    assert calls["c_call"] + calls["call"] < 1000, calls


@pytest.mark.parametrize("known", [0, 40, 500_000])
def test_cut_words_follow_the_library(monkeypatch, known):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "KNOWN", known)
    own, enc, rng = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY)), token_files.Encoder(token_files.vocabulary()), random.Random(4)
    signs = ["a", "The", "re", "é", "ß", "×", "Ā", "漢", "😀", "12", "'s", "'t", " ", " ", " ", "\n", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u180e", ".", ",", "***", "$", "[", "]", "~", "^", "<", "|", "\x01", "\x00", "\xad", "½", "\u0301", "<|endoftext|>"]
    for _ in range(8):
        texts = [None, *("".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for some in ([*rng.sample(signs, rng.randint(1, 9)), " ", "a"] for _ in range(250)))]
        ids, n = enc.batch(pa.array(texts), 2)
        ends = n.cumsum().tolist()
        for t, at, to in zip(texts, [0, *ends], ends):
            assert ids[at:to].tolist() == own.encode(t or "", add_special_tokens=False).ids + [2], t
    assert known == 500_000 or len(enc.words) <= known


def near(words):
    return {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and edit(a, b)}


def edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 9), (3, 40)])
def test_neighbours_over_many_parts(spark, seed, parts):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(5, 8))) for _ in range(250)} | {"a" * 5, "a" * 6, "a" * 3000, "a" * 3001, "b" + "a" * 3000}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(set(got)) and set(got) == near(words)


def test_word_counts_of_odd_rows(spark, monkeypatch):
    texts = [*TEXTS, "Über ÜBER über x" * 3]
    monkeypatch.setattr(spelling, "BYTES", 64)
    want = Counter()
    for k, t in enumerate(texts):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{k or ''}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 1
    want.pop("", None)
    assert {r["word"]: r["n"] for r in spelling.word_counts(rows(spark, texts), 3).collect()} == want
    assert spelling.spelling_forms(spelling.word_counts(rows(spark, []))).count() == 0


def test_lexical_search_in_small_nodes(spark, monkeypatch):
    """Several blocks of items, batches and leaves; ties, repeats and rows without an id or a text."""
    monkeypatch.setattr(lexical, "BLOCK", 40)
    for k, v in (("BATCH", 16), ("LEAF", 2), ("FAN", 2)):
        monkeypatch.setattr(lexical, k, v)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghijkl") + rng.choice("é12") for _ in range(rng.randint(0, n)))
    docs = [(k % 90 if k % 90 else None, text(30), "x") for k in range(200)] + [(500, None, "x"), (501, "", "x")]
    items = [(k, text(12), "y") for k in range(30)] + [(99, None, "y"), (98, "zz", "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, term string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = [tuple(r) for r in lexical.lexical_search(i, d, 7).orderBy("item_id", "rank").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in docs])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [r[:2] for r in items])
    want = con.sql(oracles.LEXICAL.replace("<= 50", "<= 7") + " ORDER BY item_id, rank").fetchall()
    assert got == want and len(got) > 150
    assert lexical.lexical_search(i.limit(0), d).count() == 0 and lexical.lexical_search(i, d.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_spelling_trie", "op13_dual_tree_search"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_secrets_in_many_documents_stay_secrets(spark):
    digest = lambda k: "".join(f"{(k * 2654435761 + j * 40503) % 16:x}" for j in range(40))
    texts = [(k, n, f'note {m} then token = "{digest(k)}" and {m * 7} more') for k, n in enumerate((1, 10, 100, 1000)) for m in range(n)]
    texts += [(9, 0, f"commit {digest(50 + m)} by me {m}") for m in range(20)]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "id long, text string")
    flagged = Counter(texts[r["id"]][0] for r in secrets.scan_secrets(df).where("n_secrets > 0").collect())
    assert flagged == {0: 1, 1: 10, 2: 100, 3: 1000}


def test_mixing_keeps_rows_apart_whose_nulls_differ(spark):
    docs = spark.createDataFrame([(1, "w " * 50, "en", None, 100), (1, None, "en", "w " * 50, 0), (2, "v " * 60, "en", "s", 120)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r["text"] is not None for r in stages.mixing(spark, docs, "").collect())


def test_passwords_in_addresses(spark):
    rows = [
        (1, "db postgres://bob:hunter2secret@db.host/main"), (2, "REDIS=redis://:Xk29vQz7Lp@cache:6379"), (3, "see http://host:8080/a@b and https://example.org/x"),
        (4, "amqp://user:changeme@host"), (5, None), (6, "://u:" + "abc"), (7, "x " * 5000 + "mysql://root:T3st!9431pass@db"),
    ]
    found = secrets.candidates(spark.createDataFrame(rows, "key long, text string"))
    plain = re.compile(r"://[^\s/:@]{0,64}:([^\s/@]{4,})(?=@)")
    want = {(k, m[1], m.start(1)) for k, t in rows for m in plain.finditer(t or "")}
    got = {(r["key"], r["value"], r["start"]) for r in found.where("before rlike '://[^ /@]*:$'").collect()}
    assert got == want and {k for k, _, _ in want} == {1, 2, 4, 7}
    flagged = {r["id"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "id long, text string")).where("n_secrets > 0").collect()}
    assert flagged == {1, 2, 7}


def plain_candidates(text):
    """(start, end, value, before, after) of each candidate, by Python's own patterns."""
    for m in re.finditer(secrets.CANDIDATE, text, re.A):
        pattern = f"{secrets._USER}({secrets._PASSWORD})" if m[0].startswith("://") else f"{secrets._NAME}({secrets._VALUE})"
        inner = re.fullmatch(pattern, m[0], re.A)
        value = inner[1] if inner else m[0]
        start, end = m.end() - len(value), m.end()
        yield start, end, value, text[max(0, start - secrets.REACH) : start], text[end : end + secrets.REACH]


def plain_features(value, before, after, known):
    """The forest's numbers by loops over characters."""
    n = len(value)
    kinds = ["a" if c in "abcdefghijklmnopqrstuvwxyz" else "A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "0" if c in "0123456789" else "." for c in value]
    covered, at, low = 0, 0, value.lower()
    while at < n:
        step = max((len(w) for w in known if low.startswith(w, at)), default=0)
        covered, at = covered + step, at + max(step, 1)
    has = lambda pattern, t: float(bool(re.search(pattern, t, re.A)))
    quote = before[-1:] in ('"', "'", "`") and after[:1] in ('"', "'", "`")
    path = "/" in value or has(r"[/\\.]$|://\S*$", before) or has(r"^[/\\.][a-z]", after)
    changes = sum((a, b) in {("a", "A"), ("a", "0"), ("A", "0"), ("0", "a"), ("0", "A")} for a, b in zip(kinds, kinds[1:]))
    return [
        min(n, 200), sum(c in "aeiouAEIOU" for c in value) / n, sum(c in ".:" for c in value) / n, kinds.count("0") / n, kinds.count("A") / n, kinds.count(".") / n,
        sum(c in "0123456789abcdef" for c in value) / n, len(set(value)) / min(n, 64), changes / n, covered / n, float(path), has(secrets.NAMED, before),
        has(secrets.ASSIGNED, before), float(quote), has(secrets.HARMLESS, before),
    ]


def test_secret_candidates_and_features_by_loops(spark):
    rng = random.Random(7)
    bits = ["token", "API_KEY", "db_password", " = ", "=", ": ", ":", '"', "'", "`", " ", "\n", "://", "user", "@", "host/", "sha1 ", "pwd", "aZ09" * 5, "hunter2!x", "page", "é😀", ".html", "a/b", "0f" * 20, "(", ";"]
    texts = [None, "", "x" * 9000 + ' token="abc9!defg"'] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(400)]
    known = ["pag", "page", "host", "hunter", "token", "ing"]
    found = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "key long, text string"))
    seen = found.select("*", *[c.alias(f"f_{k}") for k, c in secrets.features(F.col("value"), F.col("before"), F.col("after"), known).items()]).collect()
    want = sorted((k, *c) for k, t in enumerate(texts) for c in plain_candidates(t or ""))
    assert sorted((r["key"], r["start"], r["end"], r["value"], r["before"], r["after"]) for r in seen) == want and len(want) > 500
    for r in seen:
        assert [r[f"f_{k}"] for k in secrets.FEATURES] == pytest.approx(plain_features(r["value"], r["before"], r["after"], known)), r


def test_dictionary_of_the_corpus(spark):
    rows = [(1, "Zebra zebra quagga, xy quagga"), (2, 'my password = "quagga77" zebra'), (3, None), (4, "x_zebra zebra9 é")]
    docs = spark.createDataFrame(rows, "key long, text string")
    words = set(secrets.dictionary(docs, secrets.candidates(docs)))
    # What is a password somewhere is no word; short runs and parts of names aren't either.
    assert words == {*secrets.DICTIONARY, "zebra", "password"}
    assert set(secrets.dictionary(docs.where("key > 9"), secrets.candidates(docs.where("key > 9")))) == set(secrets.DICTIONARY)
