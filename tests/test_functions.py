"""Scalar functions on recorded vectors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sheetwise.functions import scalars as S
from sheetwise.functions import tables as T
from sheetwise.operators import distribution as D
from sheetwise.operators import geometry as G
from sheetwise.operators import ledger as L
from sheetwise.sources import readers as R


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_place(spark):
    r = one(spark, *S.place(F.lit(1000), F.lit(-500), 0.1), *S.place(F.lit(2147296545), F.lit(26558), 0.01))
    assert [round(x, 4) for x in r] == [100, -50, 21472965.45, 265.58]


def test_fixed_records(spark):
    layout = [("x1", "i16"), ("y1", "i16"), ("x2", "i16"), ("y2", "i16")]
    r = one(spark, *[S.decode_fixed(F.unhex(F.lit(h)), layout) for h in ("0a0014001e002800", "ceffe2ff6400b5ff", "0a00")])
    assert tuple(r[0]) == (10, 20, 30, 40) and tuple(r[1]) == (-50, -30, 100, -75) and r[2] is None


def test_counts(spark):
    r = one(spark, *[S.decode_count(F.unhex(F.lit(h)), e) for h, e in (("05", "zero_u16"), ("000100", "zero_u16"), ("ff2c01", "ff_u16"), ("ff2c010000", "ff_i32"), ("07", "ff_i32"))])
    assert list(r) == [5, 257, 300, 300, 7]


def test_ascii_lines(spark):
    r = one(spark, *[S.parse_ascii_geom("line", F.lit(s)) for s in ("(100,200)(300,400)", "(-100,-50)(150,-200)", "  ( 0 , 0 ) ( 1000 , 1000 )  ", " 100,200,300,400", "9 9 x 9 9")])
    assert [x["values"] for x in r] == [[100, 200, 300, 400], [-100, -50, 150, -200], [0, 0, 1000, 1000], None, None]
    assert r[3]["error"] == "Invalid ASCII line format: expected '(x1,y1)(x2,y2)', got: 100,200,300,400" and r[4]["error"]


def test_counted_ascii_geometry(spark):
    r = one(spark, *[S.parse_ascii_geom("polyline", F.lit(s)) for s in (" 3 (100,200) (300,400) (500,600)", " 1 (500,750)", " 5 (100,200) (300,400)", "0 (1,2)", "(1,2)", None)])
    assert [x["values"] for x in r] == [[100, 200, 300, 400, 500, 600], [500, 750], None, None, None, None] and all(x["error"] for x in r[2:])
    r = one(spark, *[S.parse_ascii_geom("polytriangle", F.lit(s)) for s in (" 3 (0,0) (100,0) (50,100)", "2 (0,0) (1,1)", "3 (99999999999999999999,0) (1,1) (2,2)")])
    assert r[0]["values"] == [0, 0, 100, 0, 50, 100] and "at least 3" in r[1]["error"] and r[2]["error"] == "number out of range"
    r = one(spark, *[S.parse_ascii_geom(k, F.lit(s)) for k, s in (("circle", " (500,300) 100"), ("circle", "(1,2) -5"), ("ellipse", " (400,300) 150,100"), ("ellipse", "(1,2) 3"))])
    assert r[0]["values"] == [500, 300, 100] and "radius: -5" in r[1]["error"] and r[2]["values"] == [400, 300, 150, 100] and r[3]["error"]


def test_fixed_tables():
    kinds = {c: sum(c == x for _, x, _ in T.RULES) for c in T.CATEGORIES}
    assert kinds["Text"] == 6 and kinds["Image"] == 18 and kinds["State"] == 3 and len({n for n, _, _ in T.RULES}) == len(T.RULES)
    assert len(T.FIELDS) == 36 and len(T.FORMATS) == 15 and len(T.LINE_PATTERNS) == 36
    allowed = set(T.ALLOWED)
    assert ("Null", "Block_Guid") not in allowed and ("Signature", "Parent_Block_Guid") in allowed and ("Graphics_HDR", "Password") not in allowed and ("Global", "Last_Sync_Time") in allowed


def test_colours(spark):
    r = one(spark, *[S.parse_colour(F.lit(s)) for s in ("#80FF0102", "#0a0B0c", "Transparent", "", "#zz")])
    assert [x and tuple(x) for x in r] == [(255, 1, 2, 128), (10, 11, 12, 255), None, None, (0, 0, 0, 255)]


def test_text_and_meta(spark):
    r = one(spark, S.escape_text(F.lit("a(b)\\c")), S.parse_meta("Units", F.lit(' "mm" 1 0 0 1 2 3)')), S.number_pairs(F.lit("1 -2.5,3")), S.parse_guid(F.lit("{00112233-4455-6677-8899-AABBCCDDEEFF}")), S.parse_ts(F.lit("03/04/2020 05:06:07")), S.decode_text(F.unhex(F.lit("680069"))))
    assert r[0] == "a\\(b\\)\\\\c" and r[1]["name"] == "mm" and r[1]["matrix"] == [1, 0, 0, 1, 2, 3] and [tuple(x) for x in r[2]] == [(1, -2.5)]
    assert r[3] == "00112233445566778899aabbccddeeff" and r[4].day == 4 and r[5] is not None


def test_box_modes(spark):
    df = spark.createDataFrame([(1, 1, 0, 10, 10, "center", 5), (1, 2, 0, 4294967290, 0, "vertex", None)], "drawing_id long, shape_id long, pt long, x long, y long, role string, radius long")
    all_, repaired, vertices = (G.bbox(df, m).first() for m in ("all", "repaired", "vertices"))
    assert (all_["min_x"], all_["max_y"]) == (5, 15) and repaired["min_x"] == -6 and vertices["points"] == 1


def test_golden_distribution(spark):
    rows = [("a", i, "line_16r") for i in range(3)] + [("b", 0, "line_16r"), ("b", 1, "unknown_x")]
    df = spark.createDataFrame(rows, "file string, seq long, type string")
    got = {r["type"]: (r["a"], r["b"]) for r in D.compare_files(df, ["a", "b"]).collect()}
    assert got == {"line_16r": (3, 1), "unknown_x": (None, 1)}
    assert {r["file"]: r["percent"] for r in D.coverage(df, ["line_16r"]).collect()} == {"a": 100.0, "b": 50.0, None: 80.0}


def test_markup_and_descriptor(spark):
    xml = '<FixedPage Width="100" xmlns="urn:x"><Canvas><Path Data="M 0,0" Fill="#FF0000"/><Glyphs UnicodeString="hi" OriginX="1"/><Glyphs OriginX="2"/></Canvas></FixedPage>'
    m = R.read_markup(spark.createDataFrame([("f", 1, xml), ("g", 1, "<FixedPage/>")], "file string, page int, xml string"))
    assert {tuple(r)[2:] for r in m["pages"].collect()} == {(100.0, 792.0), (612.0, 792.0)}
    p = m["paths"].collect()
    assert len(p) == 1 and p[0]["data"] == "M 0,0" and p[0]["stroke"] is None and p[0]["opacity"] == "1"
    assert [r["unicode_string"] for r in m["glyphs"].collect()] == ["hi"]
    xml = '<e:Page xmlns:e="urn:e" name="P1" plotOrder="2"><e:Paper width="10" units="in"/><e:Property name="a" value="1"/><e:Property name="a" value="2"/></e:Page>'
    d = R.read_descriptor(spark.createDataFrame([("f", xml)], "file string, xml string"))
    assert d["page"].first()["name"] == "P1" and d["paper"].first()["paper_units"] == "in" and [r["value"] for r in d["properties"].orderBy("ord").collect()] == ["1", "2"]


def test_ops_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"type": "line_16r", "points": [[1, 2]]},\n {"opcode": 5, "relative": true}]')
    got = R.read_ops_json(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [0, 1] and got[0]["points"] == [[1, 2]] and got[1]["relative"]


def test_malformed_records_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"type": "line_16r"}]')
    (tmp_path / "b.json").write_text("{oops")
    assert R.read_ops_json(spark, str(tmp_path)).count() == 1
    bad = R.malformed_ops_json(spark, str(tmp_path)).collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("b.json") and bad[0]["value"] == "{oops" and bad[0]["error"]


def test_markup_quotes_and_entities(spark):
    xml = """<!-- <Path Data='x'/> --><x:FixedPage Width='5'><Path Data='a > b' Fill = "it's &lt;&amp;lt;&#65;&#x263A;"/><PathGeometry Data="no"/></x:FixedPage>"""
    p = R.read_markup(spark.createDataFrame([("f", 1, xml)], "file string, page int, xml string"))["paths"].collect()
    assert [(r["data"], r["fill"]) for r in p] == [("a > b", "it's <&lt;A\u263a")]


def claims(spark, rows):
    return spark.createDataFrame(rows, "claim long, subject string, claim_type string, statement string, status string")


def test_merge_claims_follows_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.choice("pqr"), "accepted") for i in range(60)]
    old, new = rows[:20], rows[20:]
    seen, status, conflicts = list(old), {r[0]: r[4] for r in rows}, []
    for c in new:
        other = next((e for e in seen if e[1:3] == c[1:3] and e[3] != c[3]), None)
        if other:
            conflicts.append((c[0], other[0]))
            status[c[0]] = status[other[0]] = "challenged"
        seen.append(c)
    merged, found, counters = L.merge_claims(claims(spark, old), claims(spark, new))
    assert {r["claim"]: r["status"] for r in merged.collect()} == status
    got = found.collect()
    assert sorted((r["claim"], r["other"]) for r in got) == conflicts and all([e["to"] for e in r["edges"]] == [r["other"], r["claim"]] for r in got)
    assert tuple(counters.first()) == (40, 40 - len(conflicts), *[len(conflicts)] * 3)


def test_contradictions_of_lists(spark):
    ddl = "claim long, subjects array<string>, claim_type string, statement string"
    new, old = spark.createDataFrame([(1, ["a", "b", "c"], "x", "p")], ddl), spark.createDataFrame([(2, ["c", "b"], "x", "q"), (3, ["a"], "y", "q"), (4, ["a"], "x", "p")], ddl)
    assert [(r["old_claim"], r["overlap"]) for r in L.contradictions(new, old).collect()] == [(2, ["b", "c"])]


def test_large_tables_are_not_broadcast(spark):
    from sheetwise.operators.joins import small

    assert "broadcast" in small(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_arrays_in_many_tasks(spark, tmp_path):
    """An array over many blocks, with braces in strings, broken records and stray text; good records next to bad ones stay."""
    names = ['a', 'x}y', '{"', 'back\\slash', '}, {']
    rows = []
    for k in range(3000):
        good = json.dumps({"opcode": k, "type": names[k % 5], "origin": {"x": k, "y": -k}, "points": [[k, 1], [2, 3]]})
        rows.append('{"opcode": %d, "at": {"x": }}' % k if k % 100 == 7 else f'"oops", {good}' if k % 500 == 9 else good)
    (tmp_path / "a.json").write_text("[" + ",\n".join(rows) + "]\n")
    (tmp_path / "empty.json").write_text("[]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = R.split_ops_json(spark, str(tmp_path))
        got = sorted((r["seq"], r["opcode"], r["type"], r["origin"]["y"], r["points"]) for r in good.collect())
        faults = sorted((r["error"], r["value"][:9]) for r in bad.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(k, k, names[k % 5], -k, [[k, 1], [2, 3]]) for k in range(3000) if k % 100 != 7]
    assert len(faults) == 36 and faults[-1] == ("text between records", '"oops"')


def test_heads_of_files_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.zip", "wb") as f:
        f.write(b"PK\x03\x04")
        f.truncate(2**31 + 10)
    (tmp_path / "none").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("big.zip", "none", "missing")], "path string")
    assert [r["format"] for r in R.sniff_heads(files).collect()] == ["ZIP", "error", "error"]


def test_point_records(spark):
    cases = [("", "zero_u16"), ("00", "zero_u16"), ("01020003", "zero_u16"), ("0102000300", "zero_u16"), ("ff0000", "ff_u16"), ("ffffffffff", "ff_i32"), ("0102000300ff", "zero_u16")]
    got = one(spark, *[S.decode_points(F.unhex(F.lit(h)), e) for h, e in cases])
    assert [(r["count"], r["points"], r["error"]) for r in got] == [
        (None, None, "no whole count"), (None, None, "no whole count"), (1, None, "expected 5 bytes, found 4"), (1, [(2, 3)], None), (0, [], None), (-1, None, "negative count"), (1, None, "expected 5 bytes, found 6"),
    ]


def test_entities_are_resolved_once(spark):
    assert one(spark, R.unescaped(F.lit("&#38;lt; &amp;#65; &lt;&#x41;&apos;&quot;&gt; & &nope;")))[0] == "&lt; &#65; <A'\"> & &nope;"
    xml = "<FixedPage><![CDATA[<Path Data='no'/>]]><Path Data='M 1,2'/></FixedPage>"
    assert [r["data"] for r in R.read_markup(spark.createDataFrame([("f", 1, xml)], "file string, page int, xml string"))["paths"].collect()] == ["M 1,2"]


def test_a_crowded_key_of_claims(spark):
    """10^5 claims of each side on one key: a row for each statement, not for each pair."""
    rows = spark.range(200_000).select(F.col("id").alias("claim"), F.lit("s").alias("subject"), F.lit("t").alias("claim_type"), F.floor(F.col("id") / 4).cast("string").alias("statement"))
    g = L.contradiction_groups(rows.where("claim % 2 = 0"), rows.where("claim % 2 = 1"))
    assert g.agg(F.count("*"), F.sum("new_claims"), F.min("contradicted"), F.max("contradicted")).first() == (50_000, 100_000, 99_998, 99_998)


def test_relative_boxes_by_parts(spark):
    rng = random.Random(3)
    rows = [(d, s, s, 0, rng.choice(["origin", "rel", "rel", "rel", "abs"]), rng.randint(-9, 9), rng.randint(-9, 9)) for d in (None, 1, 2) for s in range(80)]
    df = spark.createDataFrame(rows, "drawing_id long, shape_id long, seq long, pt int, kind string, x long, y long")
    want, pen = {}, {}
    for d, _, _, _, kind, x, y in rows:
        px, py = pen.get(d, (0, 0))
        at = (x, y) if kind in ("origin", "abs") else (px + x, py + y)
        if kind != "abs":
            pen[d] = at
        want.setdefault(d, []).append(at)
    for chunk in (7, 100):
        for r in G._relative_box(df, chunk).collect():
            xs, ys = zip(*want[r["drawing_id"]])
            assert (r["min_x"], r["max_x"], r["min_y"], r["max_y"], r["points"], r["shapes"]) == (min(xs), max(xs), min(ys), max(ys), 80, 80)


@pytest.mark.parametrize("listed", [False, True])
def test_contradictions_in_blocks(spark, monkeypatch, listed):
    # Crowded keys cut into many blocks give each pair once; claims without subject, type or statement none. No plan shuffles pairs.
    monkeypatch.setattr(L, "SIDE", 3)
    rng = random.Random(5)
    pick = lambda xs: rng.choice([*xs, None]) if rng.random() < 0.2 else rng.choice(xs)
    kind = "array<string>" if listed else "string"
    sides = []
    for start in (0, 100):
        sides.append([(start + i % 25, [pick("abc") for _ in range(rng.randrange(4))] if listed else pick("ab"), pick("tu"), pick("xyz")) for i in range(30)])
    dfs = [spark.createDataFrame(x, f"claim long, {'subjects' if listed else 'subject'} {kind}, claim_type string, statement string") for x in sides]
    want = {}
    for n in sides[0]:
        for o in sides[1]:
            if n[2] and n[2] == o[2] and n[3] and o[3] and n[3] != o[3]:
                shared = [s for s in (set(n[1]) & set(o[1]) if listed else {n[1]} & {o[1]}) if s]
                if shared and listed:
                    want.setdefault((n[0], o[0], n[2], n[3], o[3]), set()).update(shared)
                elif shared:
                    want.setdefault((n[0], o[0], n[2], n[3], o[3], n[1]), []).append(1)
    found = L.contradictions(*dfs)
    key = ["new_claim", "old_claim", "claim_type", "new_statement", "old_statement"]
    if listed:
        got = [(tuple(r[k] for k in key), r["overlap"]) for r in found.collect()]
        assert len(got) == len(want) and dict(got) == {k: sorted(v) for k, v in want.items()}
    else:
        assert sorted(tuple(r[k] for k in [*key, "subject"]) for r in found.collect()) == sorted(k for k, v in want.items() for _ in v)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Aggregate" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("listed", [False, True])
def test_crowded_contradictions_shuffle_no_copies(spark, listed):
    # One key with 12,002 claims a side, nearly all of one statement: lists of claims are dealt to blocks, not each claim to all of them. Claims without a number stay.
    side = lambda start, odd: spark.range(start, start + 12_000).select("id", F.lit("p").alias("statement")).union(spark.createDataFrame([(start + 12_000, odd), (None, odd)], "id long, statement string"))
    kept = lambda x: x.select(F.col("id").alias("claim"), F.array(F.lit("s"), F.lit("t")).alias("subjects") if listed else F.lit("s").alias("subject"), F.lit("x").alias("claim_type"), "statement")
    found = L.contradictions(kept(side(0, "q")), kept(side(100_000, "q")))
    sc = spark.sparkContext
    sc.setJobGroup(f"crowded-{listed}", "")
    rows = found.agg(F.count("*"), F.count("new_claim"), F.count("old_claim"), F.count_distinct("new_claim", "old_claim")).first()
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup(f"crowded-{listed}")
    stages = {k for j in jobs for k in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    dealt = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages if sc.statusTracker().getStageInfo(k))
    assert tuple(rows) == (48_000, 36_000, 36_000, 24_000) and dealt < 60_000


def test_metadata_texts_are_parsed_once(spark):
    meta = S.parse_meta("PlotInfo", F.concat(F.lit("show 90 mm 5.5 20 0 0 5 6 1 0 0 1 0 "), F.col("id").cast("string"), F.lit(")")))
    rows = spark.range(2).select(meta.alias("m")).select("m.show", "m.unit", "m.width", F.col("m.matrix")[5].alias("f"), F.col("m.area")[1].alias("b"))
    assert [tuple(r) for r in rows.collect()] == [(True, "mm", 5.5, float(i), 0.0) for i in range(2)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_descriptor_parses_each_text_three_times(spark):
    # Values may be empty, hold entities or be missing; what was parsed is kept, so that no table of the result parses again.
    xml = '<a xmlns:e="urn:e"><e:Page name="&lt;p&gt; , " plotOrder=""/><e:Paper units="mm"/><e:Paper width="9"/><e:Property name="x" value=""/><e:Property name="x" value="2"/></a>'
    d = R.read_descriptor(spark.createDataFrame([("f", xml), ("g", "<b/>"), ("h", None)], "file string, xml string"))
    assert sorted(tuple(r) for r in d["page"].collect()) == [("f", "<p> , ", None), ("g", None, None), ("h", None, None)]
    assert sorted(tuple(r) for r in d["paper"].collect()) == [("f", None, None, "mm", None), ("g", None, None, None, None), ("h", None, None, None, None)]
    assert sorted(tuple(r) for r in d["properties"].collect()) == [("f", 0, "x", ""), ("f", 1, "x", "2")]
    assert all("xpath" not in t._jdf.queryExecution().optimizedPlan().toString() for t in d.values())


def test_scopes_are_found_once_for_both_modes(spark):
    from sheetwise.operators.kept import cut

    xml = "<Canvas RenderTransform='2,0,0,2,0,0'><Canvas RenderTransform='1,0,0,1,5,7'><Path Data='M 1,2' Fill='a'/></Canvas><Glyphs OriginX='3' OriginY='4' Fill='b'/></Canvas><Path Data='M 1,2' Fill='c'/>"
    e = cut(R.read_elements(spark.createDataFrame([("f", i, xml) for i in range(3)], "file string, page long, xml string")))
    scopes = G.element_scopes(e)
    rows = lambda df: sorted(str(r) for r in df.select("file", "page", "seq", "depth", "matrix", "data", "origin_x").collect())
    for compose in (False, True):
        assert rows(G.placed_elements(e, compose, scopes)) == rows(G.placed_elements(e, compose))


def test_arrays_summed_in_parts_of_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PIECES", 4)
    text = lambda i: '{"opcode": %d, "opcode_name": "a } { %d", "origin": {"x": %d, "y": 1}}' % (i, i, i) if i % 7 else '{"opcode": , "at": {"d": %d}}' % i
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("[" + ",\n".join(text(i) for i in range(100 * k, 100 * k + 50)) + "]")
    good, bad = R.split_ops_json(spark, str(tmp_path))
    ids = [i for k in range(2) for i in range(100 * k, 100 * k + 50)]
    assert sorted((r["seq"], r["opcode"], r["origin"]["x"]) for r in good.collect()) == sorted((i % 100, i, i) for i in ids if i % 7)
    assert sorted(r["value"] for r in bad.collect()) == sorted(text(i) for i in ids if i % 7 == 0)
