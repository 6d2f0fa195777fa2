"""Operators on documents against brute force, on awkward rows and on the smallest table."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import near_dedup as near_dedup_module
from sheetwise.llm import passages, quality, repeats
from sheetwise.llm.mixing import mix
from sheetwise.llm.near_dedup import near_duplicates, op6_minmax_near_dedup
from sheetwise.llm.passages import without_repeats_and_shared_words
from sheetwise.llm.pii import PATTERNS, find_pii, joined, op4_checked_pii, redacted
from sheetwise.llm.queries import QUERIES
from sheetwise.llm.repeats import without_repeats
from sheetwise.llm.sharding import shard_by_bytes
from sheetwise.llm.stages import near_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


# Sharding


@pytest.mark.parametrize("sizes", [[], [None, None], [5], [1] * 40, [1, 1000, 1, 1, 1], [3, None, 7, 0, 9] * 30])
def test_shards(spark, sizes):
    rows = shard_by_bytes(spark.createDataFrame([(i if i % 7 else None, s, "x") for i, s in enumerate(sizes)], "doc_id long, size long, shard string"), 8).collect()
    assert len(rows) == len(sizes)
    by = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        by.setdefault(r["shard"], []).append(r)
    flat = [r["doc_id"] for k in sorted(by) for r in by[k]]
    assert flat == sorted(flat, key=lambda d: (d is not None, d or 0))
    total = sum(s or 0 for s in sizes)
    for k, own in by.items():
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert sum(r["size"] or 0 for r in own) <= total / 8 + max(s or 0 for s in sizes)


def test_equal_rows_spread(spark):
    rows = shard_by_bytes(spark.createDataFrame([(1, 10)] * 80, "doc_id long, size long"), 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in rows) == [10] * 8


# Quality


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = [False] * len(w)
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            cover[k : k + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(cover)


def test_quality(spark, texts):
    rng = random.Random(2)
    odd = [None, "", " \n\t", "a b c d e a b c d e f", "a " * 30, "x\nx\n\nx", "é# | <b>", "w " * 20000]
    odd += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", 1) for i, t in enumerate([*odd, *texts.values()])]
    got = quality.quality_rules(spark.createDataFrame(rows, "id long, text string, lang string, source string, distance int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_stats(rows[r["id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(spark.createDataFrame([], "id long, text string, lang string, source string")).count() == 0


def determinant(x):
    floors = np.array(list(quality.FEATURES.values()), float)
    return np.linalg.slogdet(quality.CONSISTENT * np.cov(x.T, bias=True) + np.diag(floors**2))[1]


def test_determinant_against_all_halves(spark):
    """Groups of 10 and 12 rows: no half of them has a determinant much below the one found."""
    from itertools import combinations

    rng = np.random.default_rng(1)
    groups = {}
    for g in range(6):
        n = 10 + 2 * (g % 2)
        x = rng.normal([1600, 100, 50, 100], [150, 60, 80, 90], (n, 4))
        x[: n // 4] += [900, 500, 0, 700]
        groups[f"g{g}"] = x.round().astype(int)
    rows = spark.createDataFrame([(g, *map(int, v)) for g, x in groups.items() for v in x], "grp string, " + ", ".join(f"{f} long" for f in quality.FEATURES))
    got = {r["grp"]: r for r in quality.robust_estimates(rows).collect()}
    for g, x in groups.items():
        best = min(determinant(x[list(h)]) for h in combinations(range(len(x)), len(x) // 2))
        everything = determinant(x)
        assert got[g]["logdet"] <= best + 0.1 * (everything - best), (g, got[g]["logdet"], best, everything)


def test_outliers_are_far(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal([1600, 0, 0, 100], [90, 20, 30, 60], (300, 4)), rng.normal([2200, 700, 0, 0], 30, (130, 4))]).round().astype(int)
    rows = spark.createDataFrame([("g", *map(int, v)) for v in x], "grp string, " + ", ".join(f"{f} long" for f in quality.FEATURES))
    got = {tuple(r[f] for f in quality.FEATURES): r["distance"] for r in quality.outliers(rows, F.lit(True)).collect()}
    far = [got[tuple(map(int, v))] > quality.CUTOFF for v in x]
    assert not any(far[:300]) and all(far[300:])
    one = spark.createDataFrame([("a", 1, 2, 3, 4), ("b", 5, 5, 5, 5), ("b", 5, 5, 5, 5)], rows.schema)
    assert [r["distance"] for r in quality.outliers(one, F.lit(True)).collect()] == [0.0] * 3


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    d = [int(c) for c in d[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_pii(t):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii(spark, texts):
    rng = random.Random(3)
    odd = [None, "", "a@b.com%x@y.org@z.w a@@b.c a.b@c..d", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3", "4111 1111 1111 1111-1 4111-1111-1111-1111 x4111111111111111", "+1 (555) 123-4567 +1234567890123456 +1(2)3", "é😀 +1 (555) 123-4567", "1" * 20000, "a@" + "b." * 9000 + "c", "+1 (2" * 4000, "1.2.3.4 " * 3000]
    parts = ["1", "23", "4111111111111111", " ", "-", ".", "@", "a", "b.c", "+", "(", ")", "é", "x@y.z"]
    odd += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = list(enumerate([*odd, *texts.values()]))
    names = list(PATTERNS)[:4]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined(F.filter("spans", lambda s: s["rank"] < 4)).alias("base")).collect()
    assert {r["doc_id"]: r["base"] for r in got} == {i: brute_pii(t) for i, t in rows}
    q = op4_checked_pii(spark, SF).collect()
    for r in q:
        want = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in names] == [sum(x.startswith(k + ":") for x in want.split(",")) for k in names]


def test_checks_and_context(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "GB82WEST12345698765433"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "ssn 000-45-6789")]
    got = {r["id"]: r["s"] for r in find_pii(frame(spark, rows)).select("id", joined(F.col("spans")).alias("s")).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: ""}


def test_ibans_end_where_their_country_says(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF"), (2, "GB82 WEST 1234 5698 7654 32 DUE 2024"), (3, "NO9386011117947 x"), (4, "DE89 3704 0044 0532 0130 01"),
        (5, "an example iban DE89370400440532013000, a sample"), (6, "example GB82WEST12345698765432"), (7, "ssn 123-45-6789, a sample"), (8, "XX89370400440532013000"),
    ]
    got = {r["id"]: r["s"] for r in find_pii(frame(spark, rows)).select("id", joined(F.col("spans")).alias("s")).collect()}
    assert got == {1: "iban:5:32", 2: "iban:0:27", 3: "iban:0:15", 4: "", 5: "", 6: "", 7: "", 8: ""}


def test_many_matches_and_empty_tables(spark):
    from time import perf_counter

    text = "é1.2.3.4 to a@b.cd, " * 40_000
    began = perf_counter()
    r = find_pii(frame(spark, [(1, text)])).select(F.size("spans").alias("n"), redacted(F.col("text"), F.col("spans")).alias("t")).first()
    assert r["n"] == 80_000 and r["t"] == "é<IP> to <EMAIL>, " * 40_000
    assert perf_counter() - began < 60
    odd = spark.createDataFrame([("x", "s")], "text string, spans string")
    assert find_pii(odd.where("false")).count() == 0 and find_pii(odd).first()["spans"] == []


def test_redaction_across_slices(spark):
    texts = ["x" * n + " a@b.cd " + "é" * m + " +1 (555) 123-4567" for n in (0, 4090, 4095, 4096, 9000) for m in (1, 4080, 12288)]
    got = {r["id"]: r["t"] for r in find_pii(frame(spark, list(enumerate(texts)))).select("id", redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {i: t.replace("a@b.cd", "<EMAIL>").replace("+1 (555) 123-4567", "<PHONE>") for i, t in enumerate(texts)}


def test_redaction(spark):
    rows = [(1, "to a@b.cd, +1 (555) 123-4567."), (2, "none"), (3, None), (4, "😀 a@b.cd")]
    got = {r["id"]: r["t"] for r in find_pii(frame(spark, rows)).select("id", redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "to <EMAIL>, <PHONE>.", 2: "none", 3: None, 4: "😀 <EMAIL>"}


# Repeats


def brute_repeats(rows, w):
    seen = Counter((t or "").encode()[p : p + w] for _, t in rows for p in range(len((t or "").encode()) - w + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - w + 1):
            if seen[b[p : p + w]] > 1:
                gone[p : p + w] = b"\1" * w
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most, depths", [(2_000_000, 3), (1, 2), (1, 0)])
def test_repeats(spark, monkeypatch, most, depths):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh éü\n") for _ in range(n))
    p, s = text(700), text(450)
    rows = [(0, "a" * 3000), (1, None), (2, ""), (3, text(300) + p + text(50)), (4, p + text(300)), (5, s + p[:420] + s), (6, text(900)), (6, text(500)), (7, "ab" * 600), (8, "x" * 399), (9, "x" * 399), (None, s), (10, p[100:520] + p[50:600]), (11, "ab" * 199 + "c"), (12, text(100) + "a" * 400), (13, p), (13, p)]
    monkeypatch.setattr(repeats, "NAME_BYTES", most)
    monkeypatch.setattr(repeats, "DEPTHS", depths)
    assert sorted(map(tuple, without_repeats(frame(spark, rows)).collect()), key=str) == brute_repeats(rows, 400)
    assert without_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [100_000, 2_000_000])
def test_long_periods(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "NAME_BYTES", most)
    monkeypatch.setattr(repeats, "WINDOWS", 30_000)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    period = text(40)
    rows = [(1, "a" * 200_000), (2, text(500) + "a" * 420 + text(30)), (3, text(100) + period * 1000 + text(700)), (4, text(900)), (5, "b" * 401)]
    assert sorted(map(tuple, without_repeats(frame(spark, rows)).collect()), key=str) == brute_repeats(rows, 400)


@pytest.mark.parametrize("unit", ["a", "ab", "".join(random.Random(6).choice("abcdefgh") for _ in range(500))])
def test_a_megabyte_of_one_period_needs_little_memory(unit):
    import tracemalloc

    t = (unit * 1_000_000)[:1_000_000].encode()
    tracemalloc.start()
    got = repeats._block(400)(pd.DataFrame({"name": [1], "digest": [2], "bytes": [t], "windows": [len(t) - 399]}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[["x", "y"]].to_numpy().tolist() == [[0, len(t)]] and peak < 500_000_000, peak


def test_query_follows_brute_force(spark, texts):
    got = sorted(map(tuple, repeats.op5_interval_tree_dedup(spark, SF).collect()), key=str)
    assert got == brute_repeats(list(texts.items()), 400)


def brute_shared_words(rows, w):
    texts = [WORD.findall(t or "") for _, t in rows]
    strings = [[tuple(x[p : p + w]) for p in range(len(x) - w + 1)] for x in texts]
    held = Counter(s for own in strings for s in set(own))
    return [len({k for s, p in {s: p for p, s in reversed(list(enumerate(own)))}.items() if held[s] > 1 for k in range(p, p + w)}) for own in strings]


@pytest.mark.parametrize("most, depths, batch", [(2_000_000, 3, 500_000), (2_000_000, 3, 1), (1, 1, 2000), (1, 0, 500_000)])
def test_words_of_shared_passages(spark, monkeypatch, most, depths, batch):
    monkeypatch.setattr(passages, "BATCH", batch)
    monkeypatch.setattr(repeats, "NAME_BYTES", most)
    monkeypatch.setattr(repeats, "DEPTHS", depths)
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abéü") for _ in range(rng.randint(1, 6))) for _ in range(n))
    p, q, twice = text(51), text(80), text(60)
    rows = [
        (0, f"{text(30)} {p} {text(9)}"), (1, f"{p.replace(' ', chr(10))}\t{text(20)}"), (2, " ".join(p.split()[:50])), (3, f"{text(5)} {q} {text(70)} {q}"),
        (4, " ".join(q.split()[7:70])), (4, " ".join(q.split()[20:])), (5, f"{twice} {text(40)} {twice}"), (6, "a " * 3000), (7, "b a " + "a " * 60), (8, None), (9, ""),
        (None, text(60)), (10, p + "x"), (11, p[1:]), (12, text(200)), (12, text(200)), (13, twice[:40]), (14, "c d " * 300), (14, "c d " * 300),
    ]
    got = sorted(map(tuple, without_repeats_and_shared_words(frame(spark, rows)).collect()), key=str)
    assert [r[:5] for r in got] == brute_repeats(rows, 400)
    assert Counter((r[0], r[1], r[5]) for r in got) == Counter((d, len((t or "").encode()), n) for (d, t), n in zip(rows, brute_shared_words(rows, 51)))
    assert without_repeats_and_shared_words(frame(spark, [])).count() == 0


def test_registered_query_tells_shared_passages_shorter_than_400_bytes(spark, texts):
    got = sorted(map(tuple, QUERIES["op5_interval_tree_dedup"](spark, SF).collect()), key=str)
    rows = list(texts.items())
    assert [r[:5] for r in got] == brute_repeats(rows, 400)
    want = dict(zip(texts, brute_shared_words(rows, 51)))
    assert {r[0]: r[5] for r in got} == want and any(r[5] and not r[2] for r in got)


def test_maximal_groups_have_all_occurrences():
    texts = [b"xxABCDEFGHyy", b"zABCDEFGHq", b"ABCDEq"]
    text, at, groups = repeats.suffix_intervals(texts, [len(t) - 3 for t in texts], 4)
    found = {texts[text[f]][at[f] : at[f] + n]: sorted(zip(text[f : last + 1].tolist(), at[f : last + 1].tolist())) for n, f, last in groups}
    assert found == {b"ABCDEFGH": [(0, 2), (1, 1)], b"ABCDE": [(0, 2), (1, 1), (2, 0)]}


def test_sorted_suffixes_and_common_prefixes():
    rng = random.Random(8)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        b, ends = np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        order, levels = repeats.sorted_suffixes(b, ends)
        suffix = lambda x: bytes(b[x : ends[x]])
        got = [suffix(x) for x in order]
        assert sorted(order) == list(range(len(b))) and got == sorted(got)
        want = [len(re.match(b"(?s)(.*).*\\0\\1", x + b"\0" + y).group(1)) for x, y in zip(got, got[1:])]
        assert repeats.common_prefixes(b, ends, levels, order[:-1], order[1:]).tolist() == want


# Near duplicates


def brute_groups(rows, n):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(spark, texts):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "a b c d e"), (6, "a b c d e"), (7, " ".join(base)), (8, "É b c d e f"), (9, "é b c d e f")]
    for k in range(120):  # a group of near copies, some of them linked only through others
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(150)] = f"v{rng.randint(0, 10**6)}"
        rows.append((100 + k, " ".join(w)))
    got = near_duplicates(frame(spark, rows), shingle=4).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 4)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    want = brute_groups(list(texts.items()), 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op6_minmax_near_dedup(spark, SF).collect()} == want


def test_near_duplicates_of_odd_rows(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    got = near_duplicates(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "x y")])).collect()
    assert sorted((str(r["id"]), r["component_id"], r["kept"]) for r in got) == [("2", 2, True), ("3", 3, True), ("3", 3, True), ("None", None, False)]


def test_tasks_of_a_large_bucket_are_bounded(spark, monkeypatch):
    rows = [(k, " ".join([f"w{j}" for j in range(60)] + [f"v{k}_{j}" for j in range(40)])) for k in range(400)]
    monkeypatch.setattr(near_dedup_module, "CHUNK", 8)
    monkeypatch.setattr(near_dedup_module, "TASK_ROWS", 64)
    across = near_dedup_module._across

    def bounded(percent):
        compare = across(percent)

        def make(p):
            assert len(p) <= 4 * 64, len(p)
            return compare(p)

        return make

    monkeypatch.setattr(near_dedup_module, "_across", bounded)
    got = near_duplicates(frame(spark, rows), shingle=4).collect()
    assert len(got) == 400 and all(r["component_id"] == r["id"] and r["kept"] for r in got)


def test_near_duplicates_under_one_id(spark):
    rng = random.Random(3)
    text = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    one, two = text(), text()
    rows = [(6, " ".join(one)), (6, " ".join(two)), (7, near(one, 40)), (8, near(two, 90)), (9, near(two, 10))]
    got = near_duplicates(frame(spark, rows), shingle=4).collect()
    assert sorted((r["id"], r["component_id"], r["kept"]) for r in got) == [(6, 6, True), (6, 6, True), (7, 6, False), (8, 6, False), (9, 6, False)]


def test_stage_keeps_texts_without_own_ids(spark):
    rng = random.Random(4)
    text = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    a, b, c, d, e = (text() for _ in range(5))
    full = " ".join
    rows = [
        (None, full(a)), (None, full(b)), (None, near(b, 5)),  # two groups without an id
        (5, full(c)), (None, near(c, 50)), (4, near(c, 70)),  # smallest id stays
        (7, full(d)), (7, full(e)), (7, full(e)), (8, near(e, 9)),  # two texts under one id
        (9, None), (10, ""),
    ]
    docs = frame(spark, rows).select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = [(r["doc_id"], r["text"]) for r in near_dedup(spark, docs, SF).collect()]
    assert len([t for i, t in got if i is None and t in (full(b), near(b, 5))]) == 1
    want = [(None, full(a)), (4, near(c, 70)), (7, full(d)), (7, full(e)), (9, None), (10, "")]
    assert sorted((x for x in got if x[1] not in (full(b), near(b, 5))), key=str) == sorted(want, key=str)


# Mixing


def test_targets_and_copies(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None]) if i % 3 else "a", rng.choice([None, 0, 1, 7, 30, 500])) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, source string, size long")
    got = [r.asDict() for r in mix(df).collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n or 0
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.remove(s)
            rest -= target[s]
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 2 for s in names)
    again = {r["key"]: r["copies"] for r in mix(df.repartition(7)).collect()}
    assert again == {r["key"]: r["copies"] for r in got}


def test_rates_are_exponential(spark):
    """Before rounding, a source's expected copies are min(3, exp(tilt * size / mean)) with one tilt, and give its target."""
    from sheetwise.llm import mixing

    rng = random.Random(6)
    rows = [(s, rng.randint(1, 60), rng.randint(1, 9)) for s in ("a", "b", "c", None) for _ in range(30)]
    cells = spark.createDataFrame(rows, "source string, size long, n long").groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = mixing.source_targets(sizes)
    own = {}
    for r in cells.collect():
        own.setdefault(r["source"], []).append((r["size"], r["n"]))
    solved = mixing.tilts(cells, targets.withColumnRenamed("source", "s")).collect()
    assert {r["source"] for r in solved} == set(own)
    for r in solved:
        got = sum(n * s * min(3.0, np.exp(min(2.0, r["tilt"] * s / r["mean"]))) for s, n in own[r["source"]])
        full = sum(3 * s * n for s, n in own[r["source"]])
        assert abs(got - r["target"]) <= 1e-6 * r["target"] or r["target"] >= full * (1 - 1e-9)


def test_many_sources(spark, monkeypatch):
    from sheetwise.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    df = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("source"), (F.col("id") % 37).alias("size"), F.lit("x").alias("target"), F.lit(1).alias("n"))
    got = mix(df).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["copies"] * (r["key"] % 37)
        size[r["source"]] = r["source_size"]
    assert len(got) == 400 and abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)


def test_mixing_odd_tables(spark):
    ddl = "key long, source string, size long"
    assert mix(spark.createDataFrame([], ddl)).count() == 0
    assert [r["copies"] for r in mix(spark.createDataFrame([(1, None, None), (2, "x", 0)], ddl)).collect()] == [0, 0]


def test_held_out_matches_crc(spark):
    from sheetwise.llm.toxicity import held_out

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_components(spark):
    """A chain, a star, cycles, repeated edges and loops against plain searching."""
    from sheetwise.llm.graph import components

    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(900, 901), (901, 900), (950, 950)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((v, root[v]) for v in linked)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("way", ["cut", "stored"])
def test_kept_tables_leave_no_shuffle_files(spark, way):
    """A kept table needs its shuffles no more; over a long chain of steps they would fill the disk."""
    from sheetwise.llm.common import CLEANUP, cut, stored

    tops = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for top in tops for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = cut(counts) if way == "cut" else stored(counts, "counts")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert sorted(r["k"] for r in kept.collect()) == list(range(7))
    assert spark.conf.get(CLEANUP, None) == setting
    assert counts.count() == 7  # the input can still be used
