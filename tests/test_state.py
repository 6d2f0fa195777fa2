"""Order-dependent operators against known answers and plain loops over random sequences."""

import random
import time

import pytest

from pyspark.sql import functions as F

from sheetwise.operators import distribution as D
from sheetwise.operators import state as ST


def points(spark, rows):
    return spark.createDataFrame(rows, "drawing_id long, seq long, pt int, kind string, x long, y long")


def placed(df):
    return [(r["ax"], r["ay"]) for r in df.orderBy("drawing_id", "seq", "pt").collect()]


@pytest.mark.parametrize("rows, want", [
    ([("rel", 100, 50), ("rel", 50, 100), ("rel", -50, 50)], [(100, 50), (150, 150), (100, 200)]),
    ([("origin", 500, 300), ("rel", 100, 0), ("rel", 0, 100), ("rel", -100, 0)], [(500, 300), (600, 300), (600, 400), (500, 400)]),
    ([("rel", 100, 100), ("rel", 50, 50), ("rel", -50, 100)], [(100, 100), (150, 150), (100, 250)]),
    ([("origin", 200, 200), ("rel", 50, 0), ("rel", 0, 100)], [(200, 200), (250, 200), (250, 300)]),
    ([("rel", 5, 5), ("abs", 70, 80), ("rel", 1, 1)], [(5, 5), (70, 80), (6, 6)]),
    ([("rel", 5, 5), ("rel_center", 2, 2), ("rel", 1, 1)], [(5, 5), (7, 7), (6, 6)]),
])
def test_pen(spark, rows, want):
    assert placed(ST.to_absolute(points(spark, [(1, i, 0, *r) for i, r in enumerate(rows)]))) == want


def test_centres_move_the_pen(spark):
    df = points(spark, [(1, 0, 0, "rel", 5, 5), (1, 1, 0, "rel_center", 2, 2), (1, 2, 0, "rel", 1, 1)])
    assert placed(ST.to_absolute(df, centers=True)) == [(5, 5), (7, 7), (8, 8)]


def sequences(seed):
    rng = random.Random(seed)
    return [(d, s, rng.choice(["save", "restore", "reset", None, None, None] if rng.random() < 0.3 else ["save", "restore", None]), rng.choice([None, rng.randint(0, 99)])) for d in range(6) for s in range(80)]


def test_random_pen_in_chunks(spark):
    rng = random.Random(4)
    rows = [(d, s, 0, rng.choice(["origin", "rel", "rel", "rel", "abs"]), rng.randint(-9, 9), rng.randint(-9, 9)) for d in range(4) for s in range(100)]
    want, pen = [], {}
    for d, _, _, kind, x, y in rows:
        px, py = pen.get(d, (0, 0))
        at = (x, y) if kind in ("origin", "abs") else (px + x, py + y)
        if kind != "abs":
            pen[d] = at
        want.append(at)
    assert placed(ST.to_absolute(points(spark, rows))) == want
    assert placed(ST.to_absolute(points(spark, rows), chunk=7)) == want


@pytest.mark.parametrize("seed, chunk", [(1, ST.CHUNK), (2, 7), (5, 1)])
def test_scoped_state_and_audit(spark, seed, chunk):
    rows = sequences(seed)
    want, audit = [], {}
    for d in range(6):
        now, stack, a = -1, [], {"saves": 0, "restores": 0, "underflows": 0, "unmatched": 0, "max_depth": 0}
        for _, s, scope, v in (r for r in rows if r[0] == d):
            if scope == "save":
                stack.append(now)
                a["saves"] += 1
            elif scope == "restore":
                a["restores"] += 1
                if stack:
                    now = stack.pop()
                else:
                    a["underflows"] += 1
            elif scope == "reset":
                a["unmatched"] += len(stack)
                now, stack = -1, []
            elif v is not None:
                now = v
            a["max_depth"] = max(a["max_depth"], len(stack))
            want.append((d, s, len(stack), now))
        a["unmatched"] += len(stack)
        audit[d] = a
    df = spark.createDataFrame([(d, s, scope, v if scope is None else None) for d, s, scope, v in rows], "drawing_id long, seq long, scope string, colour long")
    got = [tuple(r) for r in ST.carry_scoped(df, "colour", -1, chunk).orderBy("drawing_id", "seq").collect()]
    assert got == want
    for r in ST.stack_audit(df, chunk).collect():
        assert {k: r[k] for k in audit[0]} == audit[r["drawing_id"]]


def test_node_numbers(spark):
    df = spark.createDataFrame([(1, 0, "auto", None), (1, 1, "base", 10), (1, 2, "delta", -3), (1, 3, "auto", None), (1, 4, "base", 5)], "drawing_id long, seq long, kind string, value long")
    assert [r["node"] for r in ST.node_numbers(df).orderBy("seq").collect()] == [None, 10, 7, 8, 5]


def test_composed_matrices(spark):
    df = spark.createDataFrame([(1, 0, "save", [2.0, 0.0, 0.0, 2.0, 1.0, 0.0]), (1, 1, "save", [1.0, 0.0, 0.0, 1.0, 5.0, 5.0]), (1, 2, None, None), (1, 3, "restore", None), (1, 4, None, None)], "drawing_id long, seq long, scope string, matrix array<double>")
    near = {r["seq"]: r["matrix"] for r in ST.inherit_matrix(df).collect()}
    assert near[2] == [1, 0, 0, 1, 5, 5] and near[4] == [2, 0, 0, 2, 1, 0]
    both = {r["seq"]: r["matrix"] for r in ST.inherit_matrix(df, compose=True).collect()}
    assert both[2] == [2, 0, 0, 2, 11, 10]


def test_path_with_z_and_relative_moves(spark):
    df = spark.createDataFrame([(1, 1, "M 1,2 l 3,4 Z m 1,1 h 2 V 9.5")], "drawing_id long, shape_id long, data string")
    assert [(r["x"], r["y"]) for r in ST.path_vertices(df).orderBy("pt").collect()][:3] == [(1, 2), (4, 6), (1, 2)]


@pytest.mark.parametrize("chunk", [None, 7])
def test_carried_values_in_chunks(spark, chunk):
    """Plain loops on drawings of several parts, one of them without an id."""
    rng = random.Random(9)
    rows = [(d, s, rng.choice(["base", "delta", "auto", "auto", None]), rng.randint(-9, 9), rng.choice([None, None, s]), rng.choice(["", None, f"n{s}"]), rng.randint(0, 2)) for d in (None, 1, 2) for s in range(60)]
    df = spark.createDataFrame(rows, "drawing_id long, seq long, kind string, value long, attr long, name string, key int")
    state, nodes, names = {}, {}, {}
    now = {}
    for d, s, kind, value, attr, name, key in rows:
        node, last, named = now.setdefault(d, [None, -1, {}])
        if kind == "base":
            node = value
        elif node is not None:
            node += {"delta": value, "auto": 1, None: 0}[kind]
        last, named[key] = last if attr is None else attr, name or named.get(key)
        now[d] = [node, last, named]
        state[d, s], nodes[d, s], names[d, s] = last, node, named[key]
    by = lambda df, c: {(r["drawing_id"], r["seq"]): r[c] for r in df.collect()}
    assert by(ST.carry_state(df, {"attr": -1}, chunk), "attr") == state
    assert by(ST.node_numbers(df, chunk), "node") == nodes
    assert by(ST.resolve_refs(df, "key", "name", chunk), "name") == names
    colours = df.select("drawing_id", "seq", F.when(F.col("attr").isNotNull(), F.array("attr")).alias("palette"), F.lit(0).alias("idx"))
    assert by(ST.resolve_palette(colours, chunk), "colour") == {k: None if v < 0 else v for k, v in state.items()}


@pytest.mark.parametrize("seed, chunk", [(3, ST.CHUNK), (4, 6)])
def test_group_paths_and_matrices(spark, seed, chunk):
    rows, paths, near = [(d if d else None, s, scope, f"g{s}") for d, s, scope, _ in sequences(seed)], {}, {}
    stacks = {}
    for d, s, scope, name in rows:
        stack = stacks.setdefault(d, [])
        if scope == "save":
            stack.append((name, s if s % 3 == 0 else None))
        elif scope == "restore" and stack:
            stack.pop()
        elif scope == "reset":
            stack.clear()
        paths[d, s] = "/".join(n for n, _ in stack)
        near[d, s] = next((m for _, m in reversed(stack) if m is not None), None)
    df = spark.createDataFrame(rows, "drawing_id long, seq long, scope string, name string")
    assert {(r["drawing_id"], r["seq"]): r["path"] for r in ST.group_path(df, "name", chunk).collect()} == paths
    m = df.withColumn("matrix", F.when((F.col("scope") == "save") & (F.col("seq") % 3 == 0), F.col("seq")))
    assert {(r["drawing_id"], r["seq"]): r["matrix"] for r in ST.inherit_matrix(m, chunk=chunk).collect()} == near


def test_deep_scopes(spark):
    n = 300
    rows = [(1, s, "save" if s < n else "restore", s if s % 50 == 0 and s < n else None) for s in range(2 * n)]
    df = spark.createDataFrame(rows, "drawing_id long, seq long, scope string, colour long")
    got = {r["seq"]: (r["depth"], r["colour"]) for r in ST.carry_scoped(df, "colour", -1).collect()}
    assert got[n - 1] == (n, 250) and got[2 * n - 1] == (0, -1)
    assert all(got[s] == (2 * n - 1 - s, (2 * n - 2 - s) // 50 * 50) for s in range(n, 2 * n - 1))


def test_a_hundred_thousand_nested_saves(spark):
    n = 100_000
    i = F.col("id")
    deep = spark.range(2 * n).select(F.lit(1).alias("drawing_id"), i.alias("seq"), F.when(i < n, "save").otherwise("restore").alias("scope"), F.when((i < n) & (i % 1000 == 0), i).alias("colour"))
    began = time.time()
    got = ST.carry_scoped(deep, "colour", -1, 30_000)
    s, left = F.col("seq"), 2 * n - 1 - F.col("seq")
    want = deep.select("seq", F.when(s < n, s + 1).otherwise(left).alias("d"), F.when(s < n, s - s % 1000).when(left > 0, left - 1 - (left - 1) % 1000).otherwise(-1).alias("c"))
    assert got.join(want, "seq").where("depth = d and colour = c").count() == 2 * n
    assert ST.stack_audit(deep, 30_000).first()["max_depth"] == n
    assert time.time() - began < 180  # about 50 s on four cores


def test_pages_of_one_file_in_many_ranges(spark):
    rows = [(f, f"p{k % 90:03d}", k) for f, n in ((None, 7), ("a", 300), ("b", 1)) for k in range(n)]
    got = ST.page_index(spark.createDataFrame(rows, "file string, path string, k int"), 9).collect()
    for f in (None, "a", "b"):
        own = sorted((r for r in got if r["file"] == f), key=lambda r: r["index"])
        assert [r["index"] for r in own] == list(range(len(own))) and [r["break_before"] for r in own] == [i > 0 for i in range(len(own))]
        assert [r["path"] for r in own] == sorted(r["path"] for r in own)
    assert len(got) == len(rows)


def test_until_end(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "end"), (1, 2, "a"), (1, 3, "end"), (None, 0, "end"), (None, 1, "a"), (2, 0, "a")], "drawing_id long, seq long, op string")
    assert {(r["drawing_id"], r["seq"]) for r in D.until_end(df, F.col("op") == "end").collect()} == {(1, 0), (1, 1), (None, 0), (2, 0)}
