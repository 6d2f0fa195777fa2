"""Every operator over the given tables, with its twin in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as T
from ..operators import distribution as D
from ..operators import geometry as G
from ..operators import ledger as L
from ..operators import state as ST
from ..operators.kept import cut, shared_dir
from ..sources import readers as R
from . import views as V

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function of (spark, sf_dir); sql may use the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return add


def q(c, by: int = 1000):
    """A double in whole parts, for comparison."""
    return F.floor(c * by + 0.5).cast("long")


def lit_rows(spark, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


OPS, TYPES, NAMES, PTS, RUNS, CLAIMS, DIMS, PATHS, CONTENT = V.OPS_SQL, V.TYPES_SQL, V.NAMES_SQL, V.PTS_SQL, V.RUNS_SQL, V.CLAIMS_SQL, V.DIMS_SQL, V.PATHS_SQL, V.CONTENT_SQL
values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"
RULES = f"cats AS (SELECT v_names.*, coalesce(category, 'Uncategorized') AS category FROM v_names LEFT JOIN {values([r[:2] for r in T.RULES])} r(name, category) ON type = name)"
IMPL = f"impl AS (SELECT * FROM {values([(x,) for x in T.IMPLEMENTED])} i(type))"


def whole(c):
    """A doubled number in thousandths, as text."""
    return F.when(F.abs(c) < 2e14, F.floor(c * 1000 + 0.5).cast("string")).otherwise("large")


# Sources and sinks


@query()
def s1_scan_files(spark, sf_dir):
    return R.scan_files(spark, sf_dir, "*.parquet").select("name", "bytes")


@query()
def s2_sniff_format(spark, sf_dir):
    return R.sniff_heads(R.scan_files(spark, sf_dir, "*.parquet")).select("name", "format")


@query("SELECT page_id AS file, CAST(i - 1 AS BIGINT) AS ordinal, parts[i] AS member FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)")
def s3_explode_members(spark, sf_dir):
    m = V.read(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.split("url", "/").alias("all_files"))
    return R.explode_members(m).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT drawing_id, seq, op AS type, dx AS x, dy AS y FROM v_ops", OPS)
def s4_ops_json_records(spark, sf_dir):
    # Record files of arrays of 500 records at most, one a line, as large drawings come; the reader's fields opcode and count carry the place.
    path = _scratch(spark, "records")
    record = F.struct(F.col("drawing_id").alias("opcode"), F.col("seq").alias("count"), F.col("op").alias("type"), F.array(F.array("dx", "dy")).alias("points"))
    ops = V.v_ops(spark, sf_dir).select("drawing_id", F.floor(F.col("seq") / 500).alias("part"), record.alias("r"))
    ops.groupBy("drawing_id", "part").agg(F.to_json(F.collect_list("r")).alias("value")).select("value").write.text(path)
    p = F.col("points")[0]
    return R.read_ops_json(spark, path, lines=True).select(F.col("opcode").alias("drawing_id"), F.col("count").alias("seq"), "type", p[0].alias("x"), p[1].alias("y"))


@query("""SELECT drawing_id, seq, CASE WHEN seq % 97 = 5 THEN 'no op record' ELSE op END AS type, CASE WHEN seq % 97 <> 5 THEN dx END AS x, CASE WHEN seq % 97 <> 5 THEN dy END AS y FROM v_ops
UNION ALL SELECT drawing_id, seq, 'text between records', NULL, NULL FROM v_ops WHERE seq % 89 = 3""", OPS)
def s4_ops_json_split(spark, sf_dir):
    # Files of whole arrays, told apart by their braces alone: some records don't parse, some are preceded by a stray number, names hold braces and quotes.
    path = _scratch(spark, "arrays")
    record = F.struct(F.col("drawing_id").alias("opcode"), F.col("seq").alias("count"), F.col("op").alias("type"), F.lit('a "}, {" \\\\').alias("opcode_name"), F.struct(F.col("dx").alias("x"), F.col("dy").alias("y")).alias("origin"))
    broken = F.format_string('{"opcode": , "at": {"d": %d, "s": %d}}', F.col("drawing_id"), F.col("seq"))
    text = F.when(F.col("seq") % 97 == 5, broken).otherwise(F.to_json(record))
    text = F.when(F.col("seq") % 89 == 3, F.concat(F.format_string("%d.%d, ", F.col("drawing_id"), F.col("seq")), text)).otherwise(text)
    ops = V.v_ops(spark, sf_dir).select("drawing_id", F.floor(F.col("seq") / 500).alias("part"), text.alias("r"))
    ops.groupBy("drawing_id", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n "), F.lit("]")).alias("value")).select("value").write.text(path)
    good, bad = R.split_ops_json(spark, path)
    at = lambda k: F.when(F.col("error") == "no op record", F.regexp_extract("value", r'"d": (\d+), "s": (\d+)', k)).otherwise(F.split_part("value", F.lit("."), F.lit(k))).cast("long")
    none = F.lit(None).cast("long")
    return good.select(F.col("opcode").alias("drawing_id"), F.col("count").alias("seq"), "type", "origin.x", "origin.y").union(bad.select(at(1), at(2), "error", none, none))


@query("""SELECT page_id, 'link' AS kind, CAST(i - 1 AS BIGINT) AS ord, l[i] AS value FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
UNION ALL SELECT page_id, 'heading', CAST(i - 1 AS BIGINT), l[i] FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""")
def s5_markup(spark, sf_dir):
    links, heads = R.read_html(V.read(spark, sf_dir, "pages"))
    row = lambda df, kind, c: df.select("page_id", F.lit(kind).alias("kind"), F.col("ord").cast("long").alias("ord"), F.col(c).alias("value"))
    return row(links, "link", "href").union(row(heads, "heading", "heading"))


@query("""SELECT drawing_id AS file, shape_id AS page, 'page' AS kind, CAST(0 AS BIGINT) AS ord, CAST(100 + shape_id % 500 AS VARCHAR) AS a, CASE WHEN shape_id % 2 = 0 THEN '300' ELSE '792' END AS b FROM v_pts WHERE pt = 0
UNION ALL SELECT drawing_id, shape_id, 'path', pt, 'M ' || x || ',' || y, CASE WHEN pt % 2 = 0 THEN 'a > ' || pt ELSE NULL END FROM v_pts
UNION ALL SELECT drawing_id, shape_id, 'glyphs', pt, 'x < "' || x || '" & é', CAST(y AS VARCHAR) FROM v_pts WHERE pt % 3 > 0""", PTS)
def s5_page_markup(spark, sf_dir):
    # Pages with a path and glyphs for each point; quotes of both kinds, entities, brackets in values, empty texts.
    t = lambda c: c.cast("string")
    path = lambda p: F.concat(F.lit('<Path Data="M '), t(p["x"]), F.lit(","), t(p["y"]), F.lit('"'), F.when(p["pt"] % 2 == 0, F.concat(F.lit(" Name='a > "), t(p["pt"]), F.lit("'"))).otherwise(""), F.lit("/>"))
    text = lambda p: F.when(p["pt"] % 3 > 0, F.concat(F.lit("x &lt; &quot;"), t(p["x"]), F.lit("&quot; &amp; &#233;"))).otherwise("")
    glyph = lambda p: F.concat(F.lit('<x:Glyphs UnicodeString="'), text(p), F.lit("\" OriginX='"), t(p["y"]), F.lit("'></x:Glyphs>"))
    height = F.when(F.col("shape_id") % 2 == 0, ' Height="300"').otherwise("")
    xml = F.concat(F.lit("<!-- <Path Data='no'/> --><FixedPage Width='"), t(100 + F.col("shape_id") % 500), F.lit("'"), height, F.lit("><Canvas>"), F.array_join(F.transform("p", lambda p: F.concat(path(p), glyph(p))), ""), F.lit("</Canvas></FixedPage>"))
    m = R.read_markup(V.v_shapes(spark, sf_dir).select(F.col("drawing_id").alias("file"), F.col("shape_id").alias("page"), xml.alias("xml")))
    row = lambda df, kind, o, a, b: df.select("file", "page", F.lit(kind).alias("kind"), o.cast("long").alias("ord"), a.alias("a"), b.alias("b"))
    whole = lambda c: F.col(c).cast("long").cast("string")
    return row(m["pages"], "page", F.lit(0), whole("width"), whole("height")).union(row(m["paths"], "path", F.col("ord"), F.col("data"), F.col("name"))).union(row(m["glyphs"], "glyphs", F.col("ord"), F.col("unicode_string"), F.col("origin_x")))


@query("""SELECT drawing_id AS file, shape_id AS page, pt, mode, depth, a, 'M' || printf('%.2f', CAST(a * x + c * y + e AS DOUBLE)) || ',' || printf('%.2f', CAST(b * x + d * y + f AS DOUBLE)) AS data, CAST(a * y + c * x + e AS BIGINT) AS origin_x, CAST(b * y + d * x + f AS BIGINT) AS origin_y FROM (
 SELECT p.*, mode, CASE WHEN pt < 4 THEN 0 WHEN pt < 8 OR pt >= 28 THEN 1 WHEN pt < 16 OR pt >= 24 THEN 2 ELSE 3 END AS depth, CASE WHEN shape_id % 2 = 0 AND depth > 1 THEN 1 ELSE 0 END AS even FROM v_pts p, (VALUES ('near'), ('all')) m(mode)), LATERAL (
 SELECT CASE WHEN depth = 0 THEN 1 WHEN depth = 3 THEN CASE mode WHEN 'near' THEN 0 ELSE 0 END WHEN mode = 'near' THEN CASE even WHEN 1 THEN 1 ELSE 2 END ELSE 2 END AS a, CASE WHEN depth = 3 THEN CASE mode WHEN 'near' THEN 1 ELSE 2 END ELSE 0 END AS b, CASE WHEN depth = 3 THEN CASE mode WHEN 'near' THEN -1 ELSE -2 END ELSE 0 END AS c,
  CASE WHEN depth = 0 THEN 1 WHEN depth = 3 THEN 0 WHEN mode = 'near' THEN CASE even WHEN 1 THEN 1 ELSE 2 END ELSE 2 END AS d,
  CASE WHEN depth = 0 THEN 0 WHEN depth = 3 THEN CASE mode WHEN 'near' THEN 3 ELSE 2 * (3 + 5 * even) + 10 END WHEN mode = 'near' THEN CASE even WHEN 1 THEN 5 ELSE 10 END ELSE 2 * 5 * even + 10 END AS e,
  CASE WHEN depth = 0 THEN 0 WHEN depth = 3 THEN CASE mode WHEN 'near' THEN 4 ELSE 2 * (4 + 7 * even) - 20 END WHEN mode = 'near' THEN CASE even WHEN 1 THEN 7 ELSE -20 END ELSE 2 * 7 * even - 20 END AS f)""", PTS)
def s5_placed_elements(spark, sf_dir):
    # Pages with three canvases in one another: a matrix as attribute, one on even pages alone, one as property element. Comments and CDATA hold canvases that aren't.
    t = lambda c: c.cast("string")
    opened = F.when(F.col("shape_id") % 2 == 0, '<Canvas RenderTransform="1,0,0,1,5,7">').otherwise("<Canvas>")
    before = lambda p: F.when(p["pt"] == 4, "<x:Canvas Name='a > b' RenderTransform='2, 0, 0, 2, 10, -20'><Canvas/>").when(p["pt"] == 8, opened).when(p["pt"] == 16, "<Canvas><Canvas.RenderTransform><MatrixTransform Matrix='0,1,-1,0,3,4'/></Canvas.RenderTransform>").when(p["pt"].isin(24, 28), "</Canvas>").otherwise("<![CDATA[<Canvas>]]>")
    drawn = lambda p: F.concat(F.lit('<Path Data="M '), t(p["x"]), F.lit(","), t(p["y"]), F.lit("\" Fill='#"), t(p["pt"]), F.lit("'/><Glyphs OriginX='"), t(p["y"]), F.lit("' OriginY='"), t(p["x"]), F.lit("' Fill='#"), t(p["pt"]), F.lit("' UnicodeString='z'/>"))
    xml = F.concat(F.lit("<FixedPage><!-- <Canvas> -->"), F.array_join(F.transform("p", lambda p: F.concat(before(p), drawn(p))), ""), F.lit("</x:Canvas></FixedPage>"))
    # Markup is parsed and scopes are found once for both modes, and elements are placed once for paths and texts.
    e = cut(R.read_elements(V.v_shapes(spark, sf_dir).select(F.col("drawing_id").alias("file"), F.col("shape_id").alias("page"), xml.alias("xml"))))
    scopes, out = G.element_scopes(e), []
    for mode, compose in (("near", False), ("all", True)):
        g = cut(G.placed_elements(e, compose, scopes)).withColumn("pt", F.expr("CAST(substring(fill, 2) AS BIGINT)"))
        a = F.coalesce(F.get("matrix", F.lit(0)), F.lit(1.0)).cast("int").alias("a")
        path = g.where("tag = 'Path'").select("file", "page", "pt", F.col("depth").cast("int").alias("depth"), a, F.regexp_replace("data", r"^M (-?\d+),(-?\d+)$", "M$1.00,$2.00").alias("data"))
        text = g.where("tag = 'Glyphs'").select("file", "page", "pt", F.col("origin_x").cast("long").alias("origin_x"), F.col("origin_y").cast("long").alias("origin_y"))
        out.append(path.join(text, ["file", "page", "pt"]).withColumn("mode", F.lit(mode)))
    return out[0].union(out[1])


@query("""SELECT p_partkey AS file, p_name AS page, CAST(p_size AS BIGINT) AS plot_order, p_size || '.5' AS paper_width, CASE WHEN p_size % 2 = 0 THEN 'mm' END AS paper_units, CAST(i AS BIGINT) AS ord, ['brand', 'type', 'brand'][i + 1] AS name, [p_brand, p_type, p_name][i + 1] AS value FROM part, (SELECT unnest(range(3)) AS i)""")
def s6_descriptor_properties(spark, sf_dir):
    t = lambda c: F.col(c).cast("string")
    prop = lambda name, c: F.concat(F.lit(f'<e:Property name="{name}" value="'), F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"/>'))
    units = F.when(F.col("p_size") % 2 == 0, ' units="mm"').otherwise("")
    xml = F.concat(F.lit('<e:Page xmlns:e="urn:e" name="'), F.col("p_name"), F.lit('" plotOrder="'), t("p_size"), F.lit('"><e:Paper width="'), t("p_size"), F.lit('.5"'), units, F.lit('/><e:Paper width="0"/>'), prop("brand", "p_brand"), prop("type", "p_type"), prop("brand", "p_name"), F.lit("</e:Page>"))
    d = R.read_descriptor(V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), xml.alias("xml")))
    page = d["page"].select("file", F.col("name").alias("page"), F.col("plot_order").cast("long").alias("plot_order"))
    return page.join(d["paper"].select("file", "paper_width", "paper_units"), "file").join(d["properties"].withColumn("ord", F.col("ord").cast("long")), "file")


@query("""SELECT page_id AS file, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<meta ([a-z]+)="([^"]*)"')) AS BIGINT) AS properties FROM pages""")
def s6_descriptor(spark, sf_dir):
    return V.read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit(r'<meta ([a-z]+)="([^"]*)"')).cast("long").alias("properties"),
    )


@query("SELECT run % 10 AS bucket, count(*) AS steps, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_runs GROUP BY 1", RUNS)
def s7_ledger(spark, sf_dir):
    path = _scratch(spark, "ledger")
    R.write_ledger(V.v_runs(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy((F.col("run") % 10).alias("bucket")).agg(F.count("*").alias("steps"), F.sum("bytes").alias("bytes"))


@query("SELECT type, count(*) AS n FROM v_types GROUP BY 1", TYPES)
def s8_report(spark, sf_dir):
    path = _scratch(spark, "report")
    R.write_report(V.v_types(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n")), path)
    return spark.read.schema("type string, n bigint").json(path)


def _scratch(spark, name: str) -> str:
    """A new folder where the session keeps shared files."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Projections, filters, predicates


@query("SELECT drawing_id, seq, coalesce(CASE WHEN op <> 'rel_point' THEN op END, CASE WHEN dx > 0 THEN 'named' END, 'unknown') AS type, coalesce(CASE WHEN dx % 2 = 0 THEN dx END, dy) AS x FROM v_ops", OPS)
def p1_unify_fields(spark, sf_dir):
    ops = V.v_ops(spark, sf_dir).select("drawing_id", "seq", F.when(F.col("op") != "rel_point", F.col("op")).alias("kind"), F.when(F.col("dx") > 0, "named").alias("name"), F.when(F.col("dx") % 2 == 0, F.col("dx")).alias("start_x"), F.col("dy").alias("point1_x"))
    return D.unify_fields(ops, {"type": ["kind", "name"], "x": ["start_x", "point1_x"]})


@query("SELECT file, seq, type, category FROM cats", NAMES, RULES)
def p2_classify(spark, sf_dir):
    return D.classify(V.v_names(spark, sf_dir)).select("file", "seq", "type", "category")


@query("SELECT type, regexp_matches(type, '(?i)(polytriangle|polyline|line|polygon|circle|ellipse|bezier|rectangle|contour)') AS by_words, type IN ('line', 'wedge') AS by_list, count(*) AS n FROM v_names GROUP BY ALL", NAMES)
def p3_is_geometry(spark, sf_dir):
    t = V.v_names(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return t.select("type", D.is_geometry(F.col("type")).alias("by_words"), D.is_geometry(F.col("type"), "list", ["line", "wedge"]).alias("by_list"), "n")


@query("SELECT file, seq, type FROM v_types WHERE type LIKE 'unknown%' OR type = 'error'", TYPES)
def p4_problems(spark, sf_dir):
    return D.problems(V.v_types(spark, sf_dir)).select("file", "seq", "type")


@query("""SELECT page_id AS file, CASE WHEN s AND p THEN 'Mixed' WHEN p THEN 'XPS' WHEN s THEN 'W2D' ELSE 'Unknown' END AS format, s AND NOT p AS needs_preprocessing,
CASE WHEN s AND NOT p THEN 'Extract W2D binary files,Parse W2D opcodes,Generate XPS XML pages,Create DWFX archive,Extract XPS pages,Parse XPS XML,Generate PDF' ELSE 'Extract XPS pages directly,Parse XPS XML,Generate PDF' END AS plan
FROM (SELECT page_id, bool_or(regexp_matches(m, '[?]')) AS s, bool_or(regexp_matches(m, '[.](net|org)')) AS p FROM (SELECT page_id, unnest(string_split(url, '/')) AS m FROM pages) GROUP BY 1)""")
def p5_route(spark, sf_dir):
    m = V.read(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.explode(F.split("url", "/")).alias("member"))
    return L.route(m, F.col("member").rlike("[?]"), F.col("member").rlike("[.](net|org)")).withColumn("plan", F.array_join("plan", ","))


@query("SELECT drawing_id, seq, op FROM (SELECT *, coalesce(sum(CASE WHEN op = 'reset_state' THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM v_ops) WHERE e = 0", OPS)
def p6_until_end(spark, sf_dir):
    return D.until_end(V.v_ops(spark, sf_dir), F.col("op") == "reset_state").select("drawing_id", "seq", "op")


@query("SELECT CASE WHEN size < 500 THEN 'likely empty/invisible' WHEN size < 5000 THEN 'minimal content' WHEN size < 20000 THEN 'some content' ELSE 'significant content' END AS bucket, count(*) AS n FROM v_types GROUP BY 1", TYPES)
def p7_size_bucket(spark, sf_dir):
    return V.v_types(spark, sf_dir).groupBy(S.size_bucket(F.col("size") / 100).alias("bucket")).agg(F.count("*").alias("n"))


COUNTS_SQL = """counts AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\bthe\\b')) AS BIGINT) AS n_the, CAST(len(regexp_extract_all(text, '\\bof\\b')) AS BIGINT) AS n_of,
 CAST(len(regexp_extract_all(text, '\\band\\b')) AS BIGINT) AS n_and, CAST(len(regexp_extract_all(text, '\\bde\\b')) AS BIGINT) AS n_de FROM documents)"""
TOKENS = {f"n_{w}": rf"(?<![0-9A-Za-z_]){w}(?![0-9A-Za-z_])" for w in ("the", "of", "and", "de")}


def counts(spark, sf_dir):
    docs = V.read(spark, sf_dir, "documents").select("doc_id", "text")
    return L.token_counts(docs, TOKENS, {"n_all": list(TOKENS)})


@query("""SELECT doc_id, concat_ws(',', CASE WHEN n_the > 1000 THEN 'Technical Drawing (High complexity)' WHEN n_the > 100 THEN 'Technical Drawing (Medium complexity)' WHEN n_the > 10 THEN 'Simple Diagram' END,
 CASE WHEN n_of > 100 THEN 'Contains significant text' WHEN n_of > 0 THEN 'Contains some text' ELSE 'Minimal or no text' END,
 CASE WHEN n_and > n_de * 2 THEN 'Predominantly filled shapes' WHEN n_de > n_and * 2 THEN 'Predominantly line drawings' ELSE 'Mix of fills and strokes' END) AS labels FROM counts""", COUNTS_SQL)
def p8_content_labels(spark, sf_dir):
    return counts(spark, sf_dir).select("doc_id", F.array_join(L.content_labels(F.col("n_the"), F.col("n_of"), F.col("n_and"), F.col("n_de")), ",").alias("labels"))


@query("SELECT drawing_id, seq, concat_ws(',', CASE WHEN abs(dx) > 95 THEN 'x out of range' END, CASE WHEN op = 'set_attr' AND k < 3 THEN 'bad key' END) AS errors FROM v_ops WHERE abs(dx) > 95 OR (op = 'set_attr' AND k < 3)", OPS)
def p9_quarantine(spark, sf_dir):
    _, bad = D.split_valid(V.v_ops(spark, sf_dir), {"x out of range": F.abs("dx") > 95, "bad key": (F.col("op") == "set_attr") & (F.col("k") < 3)})
    return bad.select("drawing_id", "seq", F.array_join("errors", ",").alias("errors"))


@query("SELECT drawing_id, shape_id, kind, n FROM (SELECT drawing_id, shape_id, CASE shape_id % 4 WHEN 0 THEN 'polygon' WHEN 1 THEN 'quad' WHEN 2 THEN 'bezier' ELSE 'polyline' END AS kind, shape_id % 33 AS n FROM v_pts WHERE pt = 0) WHERE CASE kind WHEN 'polygon' THEN n >= 3 WHEN 'quad' THEN n = 4 WHEN 'bezier' THEN n >= 4 ELSE n >= 1 END", PTS)
def p10_drawable(spark, sf_dir):
    p = V.v_pts(spark, sf_dir).where(F.col("pt") < F.col("shape_id") % 33).groupBy("drawing_id", "shape_id").agg(F.collect_list(F.struct("pt", "x", "y")).alias("points"))
    kind = F.get(F.array(*map(F.lit, ("polygon", "quad", "bezier", "polyline"))), (F.col("shape_id") % 4).cast("int"))
    return G.drawable(p.withColumn("kind", kind).withColumn("text", F.lit(None).cast("string"))).select("drawing_id", "shape_id", "kind", F.size("points").cast("long").alias("n"))


@query("SELECT drawing_id, shape_id, pt FROM v_pts WHERE abs(x * 0.1 - y * 0.1) < 0.001", PTS)
def p11_within(spark, sf_dir):
    x, y = S.place(F.col("x"), F.col("y"), 0.1)
    return V.v_pts(spark, sf_dir).where(S.within(x, y)).select("drawing_id", "shape_id", "pt")


# Joins


@query("SELECT file, seq, type FROM v_names WHERE type IN (SELECT type FROM impl)", NAMES, IMPL)
def j1_covered(spark, sf_dir):
    return D.covered(V.v_names(spark, sf_dir), D.implemented_table(spark)).select("file", "seq", "type")


@query("SELECT category, type, count(*) AS n FROM cats WHERE type NOT IN (SELECT type FROM impl) GROUP BY ALL HAVING count(*) > 3", NAMES, RULES, IMPL)
def j2_missing(spark, sf_dir):
    return D.missing(D.classify(V.v_names(spark, sf_dir)), D.implemented_table(spark), above=3)


@query("SELECT t AS type, min(file) AS file FROM (SELECT type || '/' || (size % 1000) AS t, file FROM v_types) GROUP BY 1 HAVING count(DISTINCT file) = 1", TYPES)
def j3_unique_to_file(spark, sf_dir):
    return D.unique_to_file(V.v_types(spark, sf_dir).withColumn("type", F.concat("type", F.lit("/"), (F.col("size") % 1000).cast("string")))).select("type", "file")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def j4_decode_codes(spark, sf_dir):
    dim = V.read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return L.decode_codes(V.read(spark, sf_dir, "nation"), dim, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("""SELECT drawing_id, seq, CASE WHEN k % 5 = 0 THEN p WHEN k % 5 = 1 THEN -p WHEN k % 5 = 2 THEN p + 1 END AS colour
FROM (SELECT *, last_value(CASE WHEN op = 'set_origin' THEN a END IGNORE NULLS) OVER (PARTITION BY drawing_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p FROM v_ops) WHERE op = 'set_attr'""", OPS)
def j5_resolve_palette(spark, sf_dir):
    a = F.col("a")
    ops = V.v_ops(spark, sf_dir).withColumn("palette", F.when(F.col("op") == "set_origin", F.array(a, -a, a + 1))).withColumn("idx", F.when(F.col("op") == "set_attr", F.col("k") % 5))
    return ST.resolve_palette(ops).where("op = 'set_attr'").select("drawing_id", "seq", "colour")


@query("SELECT drawing_id, seq, k % 5 AS key, last_value(CASE WHEN op = 'set_attr' THEN CAST(a AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY drawing_id, k % 5 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS name FROM v_ops", OPS)
def j6_resolve_refs(spark, sf_dir):
    ops = V.v_ops(spark, sf_dir).select("drawing_id", "seq", (F.col("k") % 5).alias("key"), F.when(F.col("op") == "set_attr", F.col("a").cast("string")).otherwise("").alias("name"))
    return ST.resolve_refs(ops, "key", "name")


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, u.name AS unit, p.name AS pattern, m.name AS marker FROM lineitem
LEFT JOIN {values([(k, n) for x, k, n in T.CODES if x == "unit"])} u(code, name) ON u.code = l_linenumber LEFT JOIN {values([(k, n) for x, k, n in T.CODES if x == "line_pattern"])} p(code, name) ON p.code = CAST(l_quantity AS BIGINT)
LEFT JOIN {values([(k, n) for x, k, n in T.CODES if x == "marker"])} m(code, name) ON m.code = l_orderkey % 9""")
def j4_fixed_codes(spark, sf_dir):
    rows = V.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_orderkey") % 9).alias("symbol"))
    for key, kind, name in (("line", "unit", "unit"), ("quantity", "line_pattern", "pattern"), ("symbol", "marker", "marker")):
        rows = L.decode_codes(rows, L.codes_table(spark, kind).withColumnsRenamed({"code": key, "name": name}), key)
    return rows.select("l_orderkey", "line", "unit", "pattern", "marker")


PAGES_SQL = "sizes AS (SELECT * FROM (VALUES " + ", ".join(f"({2 * k + o}, '{n}', {w}, {h})" for k, (n, a, b) in enumerate(G.PAGES) for o, (w, h) in enumerate(((a, b), (b, a)))) + ") AS t(k, name, w, h))"


@query("SELECT id, CASE WHEN d < 50 THEN name END AS page, CAST(d AS BIGINT) AS distance FROM (SELECT id, abs(width - w) + abs(height - h) AS d, name, row_number() OVER (PARTITION BY id ORDER BY abs(width - w) + abs(height - h), k) AS r FROM v_dims, sizes) WHERE r = 1", DIMS, PAGES_SQL)
def j7_nearest_page(spark, sf_dir):
    return G.nearest_page(V.v_dims(spark, sf_dir)).select("id", "page", F.col("distance").cast("long").alias("distance"))


@query("SELECT a.claim AS new_claim, b.claim AS old_claim, a.subject, a.claim_type, a.statement AS new_statement, b.statement AS old_statement FROM v_claims a JOIN v_claims b ON a.subject = b.subject AND a.claim_type = b.claim_type AND a.statement <> b.statement WHERE a.claim % 2 = 1 AND b.claim % 2 = 0", CLAIMS)
def j8_contradictions(spark, sf_dir):
    c = V.v_claims(spark, sf_dir)
    return L.contradictions(c.where("claim % 2 = 1"), c.where("claim % 2 = 0")).select("new_claim", "old_claim", "subject", "claim_type", "new_statement", "old_statement")


@query("""SELECT subject, claim_type, statement, new_claims, old_claims, CAST(o - old_claims AS BIGINT) AS contradicted FROM g JOIN (SELECT subject, claim_type, sum(old_claims) AS o FROM g GROUP BY ALL) USING (subject, claim_type) WHERE new_claims > 0 AND o > old_claims""",
       CLAIMS, "g AS (SELECT subject, claim_type, statement, count(*) FILTER (claim % 2 = 1) AS new_claims, count(*) FILTER (claim % 2 = 0) AS old_claims FROM v_claims GROUP BY ALL)")
def j8_contradiction_groups(spark, sf_dir):
    c = V.v_claims(spark, sf_dir)
    return L.contradiction_groups(c.where("claim % 2 = 1"), c.where("claim % 2 = 0"))


@query("""SELECT a.claim AS new_claim, b.claim AS old_claim, a.claim_type, CASE WHEN a.subject = b.subject AND a.claim % 7 = b.claim % 7 THEN a.claim % 7 || ',' || a.subject WHEN a.subject = b.subject THEN a.subject ELSE CAST(a.claim % 7 AS VARCHAR) END AS overlap
FROM v_claims a JOIN v_claims b ON a.claim_type = b.claim_type AND a.statement <> b.statement AND (a.subject = b.subject OR a.claim % 7 = b.claim % 7) WHERE a.claim % 2 = 1 AND b.claim % 2 = 0""", CLAIMS)
def j8_contradictions_listed(spark, sf_dir):
    # Two subjects a claim: its brand and one of seven numbers.
    c = V.v_claims(spark, sf_dir).withColumn("subjects", F.array("subject", (F.col("claim") % 7).cast("string"))).drop("subject")
    pairs = L.contradictions(c.where("claim % 2 = 1"), c.where("claim % 2 = 0"))
    return pairs.select("new_claim", "old_claim", "claim_type", F.array_join("overlap", ",").alias("overlap"))


#: The first claim before each new (odd) one, of the state (even) or new, on the same subject and type that states something else.
FIRST_SQL = """f AS (SELECT claim, claim_type, other FROM (SELECT a.claim, a.claim_type, b.claim AS other, row_number() OVER (PARTITION BY a.claim ORDER BY b.claim % 2, b.claim) AS r
 FROM v_claims a JOIN v_claims b ON a.subject = b.subject AND a.claim_type = b.claim_type AND a.statement <> b.statement AND (b.claim % 2 = 0 OR b.claim < a.claim) WHERE a.claim % 2 = 1) WHERE r = 1)"""


@query("""SELECT claim, CASE WHEN claim IN (SELECT claim FROM f) OR claim IN (SELECT other FROM f) THEN 'challenged' ELSE status END AS status FROM v_claims""", CLAIMS, FIRST_SQL)
def j9_merge_claims(spark, sf_dir):
    c = V.v_claims(spark, sf_dir)
    return L.merge_claims(c.where("claim % 2 = 0"), c.where("claim % 2 = 1"))[0].select("claim", "status")


@query("SELECT claim, other, claim_type, other || '>' || claim AS edges FROM f", CLAIMS, FIRST_SQL)
def j9_conflicts(spark, sf_dir):
    c = V.v_claims(spark, sf_dir)
    found = L.merge_claims(c.where("claim % 2 = 0"), c.where("claim % 2 = 1"))[1]
    return found.select("claim", "other", "claim_type", F.array_join(F.transform("edges", lambda e: e["to"].cast("string")), ">").alias("edges"))


@query("SELECT n AS attempted, n - k AS accepted, k AS rejected, k AS contradictions, k AS conflict_nodes FROM (SELECT (SELECT count(*) FROM v_claims WHERE claim % 2 = 1) AS n, (SELECT count(*) FROM f) AS k)", CLAIMS, FIRST_SQL)
def j9_counters(spark, sf_dir):
    c = V.v_claims(spark, sf_dir)
    return L.merge_claims(c.where("claim % 2 = 0"), c.where("claim % 2 = 1"))[2]


BOX_SQL = "box AS (SELECT drawing_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(x) - min(x) AS width, max(y) - min(y) AS height, count(*) AS points, count(DISTINCT shape_id) AS shapes FROM v_pts GROUP BY 1)"


@query("""SELECT drawing_id, CASE WHEN p < 1 THEN 'match' WHEN p < 5 THEN 'close' ELSE 'mismatch' END AS match, CAST(floor(p * 1000 + 0.5) AS BIGINT) AS percent, CAST(floor(sx * 1000 + 0.5) AS BIGINT) AS scale_x, CAST(floor(sy * 1000 + 0.5) AS BIGINT) AS scale_y FROM (
SELECT drawing_id, pw / width AS sx, ph / height AS sy, 100 * abs(width / height - pw / ph) / (pw / ph) AS p FROM box JOIN (SELECT nation AS drawing_id, CAST(max(width) AS DOUBLE) AS pw, CAST(max(height) AS DOUBLE) AS ph FROM v_dims GROUP BY 1) USING (drawing_id))""", PTS, DIMS, BOX_SQL)
def j10_compare_pages(spark, sf_dir):
    pages = V.v_dims(spark, sf_dir).groupBy(F.col("nation").alias("drawing_id")).agg(F.max("width").cast("double").alias("page_width"), F.max("height").cast("double").alias("page_height"))
    return G.compare_pages(G.bbox(V.v_pts(spark, sf_dir)), pages).select("drawing_id", "match", q(F.col("percent")).alias("percent"), q(F.col("scale_x")).alias("scale_x"), q(F.col("scale_y")).alias("scale_y"))


@query(f"""SELECT o_orderkey, format, field FROM (SELECT o_orderkey, [{", ".join(f"'{f}'" for f in T.FORMATS)}][o_custkey % {len(T.FORMATS)} + 1] AS format, field FROM orders,
 (SELECT unnest([{", ".join(f"'{f}'" for f in T.FIELDS)}]) AS field, unnest(range({len(T.FIELDS)})) AS k) WHERE (o_orderkey + k) % 5 < 2) WHERE (format, field) NOT IN (SELECT (f, x) FROM {values(T.ALLOWED)} a(f, x))""")
def j11_check_fields(spark, sf_dir):
    # Each order is a block of some format that sets two of five fields.
    own = [F.when((F.col("o_orderkey") + k) % 5 < 2, F.lit(k)).alias(f) for k, f in enumerate(T.FIELDS)]
    kind = F.get(F.array(*map(F.lit, T.FORMATS)), (F.col("o_custkey") % len(T.FORMATS)).cast("int"))
    return L.check_fields(V.read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), *own), "o_orderkey", "kind", T.FIELDS, L.allowed_table(spark))


# Aggregations


@query("SELECT file, type, n, CAST(floor(100.0 * n / sum(n) OVER (PARTITION BY file) * 1000 + 0.5) AS BIGINT) AS percent FROM (SELECT file, type, count(*) AS n FROM v_types GROUP BY ALL)", TYPES)
def a1_type_counts(spark, sf_dir):
    return D.type_counts(V.v_types(spark, sf_dir)).withColumn("percent", q(F.col("percent")))


@query("SELECT file, category, n, CAST(floor(100.0 * n / sum(n) OVER (PARTITION BY file) * 1000 + 0.5) AS BIGINT) AS percent FROM (SELECT file, category, count(*) AS n FROM cats GROUP BY ALL)", NAMES, RULES)
def a2_category_counts(spark, sf_dir):
    return D.type_counts(D.classify(V.v_names(spark, sf_dir)), "category").withColumn("percent", q(F.col("percent")))


@query("SELECT type, size % 10 AS code, count(*) AS n, arg_min('size ' || size, file * 100000000 + seq) AS sample FROM v_types WHERE type = 'error' GROUP BY ALL", TYPES)
def a3_problem_groups(spark, sf_dir):
    return D.problem_groups(V.v_types(spark, sf_dir).withColumn("code", F.col("size") % 10).withColumn("message", F.concat(F.lit("size "), F.col("size").cast("string"))))


@query("SELECT type, " + ", ".join(f"nullif(count(*) FILTER (file % 5 = {k}), 0) AS file_{k}" for k in range(5)) + " FROM v_names GROUP BY 1", NAMES)
def a4_compare_files(spark, sf_dir):
    # Every file takes part, in one of five groups.
    p = D.compare_files(V.v_names(spark, sf_dir).withColumn("file", F.col("file") % 5), list(range(5)))
    return p.select("type", *[F.col(str(k)).alias(f"file_{k}") for k in range(5)])


@query("SELECT file, count(*) AS total, count(*) FILTER (type IN (SELECT type FROM impl)) AS covered, CAST(floor(100.0 * count(*) FILTER (type IN (SELECT type FROM impl)) / count(*) * 1000 + 0.5) AS BIGINT) AS percent FROM v_names GROUP BY ROLLUP (file)", NAMES, IMPL)
def a5_coverage(spark, sf_dir):
    return D.coverage(V.v_names(spark, sf_dir), T.IMPLEMENTED).withColumn("percent", q(F.col("percent")))


@query("SELECT file, count(*) FILTER (type = 'click') AS n, CAST(floor(CASE WHEN sum(size) = 0 THEN 0 ELSE count(*) FILTER (type = 'click') / (CAST(sum(size) AS BIGINT) / 1048576.0) END * 1000 + 0.5) AS BIGINT) AS per_mb FROM v_types GROUP BY 1", TYPES)
def a6_ops_per_mb(spark, sf_dir):
    t = V.v_types(spark, sf_dir)
    return D.ops_per_mb(t, t.groupBy("file").agg(F.sum("size").alias("bytes")), F.col("type") == "click").withColumn("per_mb", q(F.col("per_mb")))


@query("SELECT *, CAST(floor(width / height * 1000 + 0.5) AS BIGINT) AS aspect FROM box", PTS, BOX_SQL)
def a7_bbox(spark, sf_dir):
    return G.bbox(V.v_pts(spark, sf_dir)).withColumn("aspect", q(F.col("aspect")))


@query("""SELECT mode, drawing_id, min(x - r) AS min_x, max(x + r + w) AS max_x, min(y - r) AS min_y, max(y + r + h) AS max_y, count(*) AS points, count(DISTINCT shape_id) AS shapes FROM (
 SELECT drawing_id, shape_id, m.mode, CASE WHEN m.mode = 'repaired' AND pt = 31 THEN x ELSE CASE WHEN pt = 31 THEN x + 4294967296 ELSE x END END AS x, y,
  CASE WHEN m.mode IN ('all', 'repaired') AND pt % 5 = 3 THEN 7 ELSE 0 END AS r, CASE WHEN m.mode IN ('all', 'repaired') AND pt % 5 = 4 THEN 11 ELSE 0 END AS w, CASE WHEN m.mode IN ('all', 'repaired') AND pt % 5 = 4 THEN 3 ELSE 0 END AS h
 FROM v_pts, (VALUES ('all'), ('vertices'), ('anchors'), ('repaired')) m(mode) WHERE m.mode <> 'vertices' OR pt % 5 < 3) GROUP BY ALL
UNION ALL SELECT 'relative', drawing_id, min(ax - r), max(ax + r + w), min(ay - r), max(ay + r + h), count(*), count(DISTINCT shape_id) FROM (SELECT drawing_id, shape_id, CASE WHEN pt % 5 = 3 THEN 7 ELSE 0 END AS r, CASE WHEN pt % 5 = 4 THEN 11 ELSE 0 END AS w, CASE WHEN pt % 5 = 4 THEN 3 ELSE 0 END AS h,
 CASE WHEN kind = 'abs' THEN x ELSE CAST(sum(CASE WHEN kind = 'abs' THEN 0 ELSE x END) OVER v AS BIGINT) END AS ax, CASE WHEN kind = 'abs' THEN y ELSE CAST(sum(CASE WHEN kind = 'abs' THEN 0 ELSE y END) OVER v AS BIGINT) END AS ay
 FROM (SELECT *, count(*) FILTER (kind = 'origin') OVER (PARTITION BY drawing_id ORDER BY shape_id, pt) AS seg FROM (SELECT *, CASE WHEN pt = 0 AND shape_id % 3 = 0 THEN 'origin' WHEN pt % 7 = 5 THEN 'abs' ELSE 'rel' END AS kind FROM v_pts)) WINDOW v AS (PARTITION BY drawing_id, seg ORDER BY shape_id, pt)) GROUP BY drawing_id""", PTS)
def a7_bbox_modes(spark, sf_dir):
    # Points have the five roles in turn; the last of a shape has wrapped around 32 bits.
    role = F.get(F.array(*map(F.lit, ("vertex", "start", "end", "center", "position"))), (F.col("pt") % 5).cast("int"))
    p = V.v_pts(spark, sf_dir).withColumns({
        "role": role, "x": F.when(F.col("pt") == 31, F.col("x") + 2**32).otherwise(F.col("x")), "radius": F.when(F.col("pt") % 5 == 3, 7),
        "w": F.when(F.col("pt") % 5 == 4, 11), "h": F.when(F.col("pt") % 5 == 4, 3),
    })
    each = [G.bbox(p, m).select(F.lit(m).alias("mode"), "drawing_id", "min_x", "max_x", "min_y", "max_y", "points", "shapes") for m in ("all", "vertices", "anchors", "repaired")]
    # One shape in three sets the pen; the others go on from where it is.
    kind = F.when((F.col("pt") == 0) & (F.col("shape_id") % 3 == 0), "origin").when(F.col("pt") % 7 == 5, "abs").otherwise("rel")
    moved = G.bbox(p.withColumns({"seq": F.col("shape_id"), "kind": kind, "x": V.v_unwrapped(F.col("x"), F.col("pt"))}), "relative")
    return D.reduce(DataFrame.union, [*each, moved.select(F.lit("relative").alias("mode"), *each[0].columns[1:])])


@query("SELECT nation AS file, CAST(floor(avg(width) * 1000 + 0.5) AS BIGINT) AS width, CAST(floor(avg(height) * 1000 + 0.5) AS BIGINT) AS height, count(*) AS pages, CAST(floor(avg(width) / avg(height) * 1000 + 0.5) AS BIGINT) AS ratio FROM v_dims GROUP BY 1", DIMS)
def a8_page_summary(spark, sf_dir):
    return G.page_summary(V.v_dims(spark, sf_dir).withColumnRenamed("nation", "file")).withColumns({c: q(F.col(c)) for c in ("width", "height", "ratio")})


@query("""SELECT file, suffix, n, bytes, CAST(floor(CAST(sum(CASE WHEN suffix IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'gif', 'bmp') THEN bytes ELSE 0 END) OVER (PARTITION BY file) AS DOUBLE) / sum(bytes) OVER (PARTITION BY file) * 1000 + 0.5) AS BIGINT) AS image_share
FROM (SELECT page_id % 10 AS file, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([^.]*)$', 1)) AS suffix, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS bytes FROM pages GROUP BY ALL)""")
def a9_member_profile(spark, sf_dir):
    m = V.read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("file"), S.suffix(F.col("url")).alias("suffix"), F.length("html").cast("long").alias("bytes"))
    return L.member_profile(m).withColumn("image_share", q(F.col("image_share")))


@query("SELECT *, " + ", ".join(" + ".join(ts) + f" AS {k}" for k, ts in T.TOKEN_TOTALS.items()) + " FROM (SELECT drawing_id, shape_id, mode, "
       + ", ".join(f"CAST(len(regexp_extract_all(text, CASE mode WHEN 'space' THEN '[ \\t\\n\\x0B\\f\\r]{t}(?:[ \\t\\n\\x0B\\f\\r]|$)' ELSE ' {t}[ \\n]' END)) AS BIGINT) AS {name}" for name, t in T.TOKENS.items()) + " FROM v_content, (VALUES ('space'), ('literal')) m(mode))", CONTENT)
def a10_token_counts(spark, sf_dir):
    c = V.v_content(spark, sf_dir)
    return L.token_counts(c.withColumn("mode", F.lit("space")), L.token_patterns(), T.TOKEN_TOTALS).union(L.token_counts(c.withColumn("mode", F.lit("literal")), L.token_patterns("literal"), T.TOKEN_TOTALS))


@query("SELECT run AS batch, count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, string_agg(ordinal || ':' || CASE WHEN ok THEN 'success' ELSE 'failed' END, ',' ORDER BY ordinal, ok) AS statuses FROM v_runs GROUP BY 1", RUNS)
def a11_batch_summary(spark, sf_dir):
    s = L.batch_summary(V.v_runs(spark, sf_dir).select(F.col("run").alias("batch"), F.col("ordinal").alias("input"), "ok"))
    return s.withColumn("statuses", F.array_join(F.transform("statuses", lambda x: F.concat_ws(":", x["input"].cast("string"), x["status"])), ","))


@query("SELECT count(DISTINCT s) AS subjects FROM (SELECT unnest([subject, claim_type]) AS s FROM v_claims)", CLAIMS)
def a12_distinct_subjects(spark, sf_dir):
    return L.distinct_subjects(V.v_claims(spark, sf_dir).withColumn("subjects", F.array("subject", "claim_type")))


@query("SELECT drawing_id, shape_id, pt // 3 AS part, CAST(floor(avg(x % 256) * 1000 + 0.5) AS BIGINT) AS r, CAST(floor(avg(y % 256) * 1000 + 0.5) AS BIGINT) AS g, CAST(floor(avg(pt % 256) * 1000 + 0.5) AS BIGINT) AS b FROM v_pts GROUP BY ALL HAVING count(*) = 3", PTS)
def a13_flat_colours(spark, sf_dir):
    v = V.v_pts(spark, sf_dir).select("drawing_id", "shape_id", "pt", (F.col("x") % 256).alias("r"), (F.col("y") % 256).alias("g"), (F.col("pt") % 256).alias("b"))
    return G.flat_colours(v).withColumns({c: q(F.col(c)) for c in "rgb"})


@query("SELECT * FROM (SELECT drawing_id, shape_id, pt AS part, " + ", ".join(f"CAST(floor(({c} + lead({c}) OVER w) / 2 * 1000 + 0.5) AS BIGINT) AS {n}" for c, n in (("x % 256", "r"), ("y % 256", "g"), ("pt % 256", "b"))) + " FROM v_pts WINDOW w AS (PARTITION BY drawing_id, shape_id ORDER BY pt)) WHERE r IS NOT NULL", PTS)
def a13_flat_segments(spark, sf_dir):
    v = V.v_pts(spark, sf_dir).select("drawing_id", "shape_id", "pt", (F.col("x") % 256).alias("r"), (F.col("y") % 256).alias("g"), (F.col("pt") % 256).alias("b"))
    return G.flat_colours(v, 2).withColumns({c: q(F.col(c)) for c in "rgb"})


@query("SELECT run AS file, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_runs WHERE ok GROUP BY 1", RUNS)
def a14_image_totals(spark, sf_dir):
    return L.image_totals(V.v_runs(spark, sf_dir).withColumnRenamed("run", "file"), F.col("ok"))


@query("SELECT drawing_id, 'x' AS field, min(x) AS least, max(x) AS largest, count(x) AS n, bool_or(shape_id % 100 = 0) AS relative FROM v_pts GROUP BY 1 UNION ALL SELECT drawing_id, 'y', min(y), max(y), count(y), bool_or(shape_id % 100 = 0) FROM v_pts GROUP BY 1", PTS)
def a15_coord_profile(spark, sf_dir):
    return G.coord_profile(V.v_pts(spark, sf_dir).withColumn("relative", F.col("shape_id") % 100 == 0))


@query("SELECT file, type, count(*) AS n, CAST(grouping_id(file, type) AS BIGINT) AS level FROM v_types GROUP BY ROLLUP (file, type)", TYPES)
def a16_rollup_counts(spark, sf_dir):
    return D.rollup_counts(V.v_types(spark, sf_dir))


@query("SELECT run, ordinal, CAST(epoch_ms(time) - lag(epoch_ms(time)) OVER (PARTITION BY run ORDER BY ordinal, time) AS BIGINT) AS elapsed, CAST(max(epoch_ms(time)) OVER (PARTITION BY run) - min(epoch_ms(time)) OVER (PARTITION BY run) AS BIGINT) AS run_ms FROM v_runs", RUNS)
def a17_run_durations(spark, sf_dir):
    return L.run_durations(V.v_runs(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))).select("run", "ordinal", "elapsed", "run_ms")


# Windows

ABS_SQL = """moved AS (SELECT drawing_id, seq, op, sum(CASE WHEN op = 'set_origin' THEN 1 ELSE 0 END) OVER w AS seg, CASE WHEN op = 'set_origin' THEN a WHEN op = 'rel_point' THEN dx ELSE 0 END AS mx, CASE WHEN op = 'set_origin' THEN -a WHEN op = 'rel_point' THEN dy ELSE 0 END AS my FROM v_ops WINDOW w AS (PARTITION BY drawing_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 pen AS (SELECT drawing_id, seq, op, CAST(sum(mx) OVER w AS BIGINT) AS ax, CAST(sum(my) OVER w AS BIGINT) AS ay FROM moved WINDOW w AS (PARTITION BY drawing_id, seg ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def pen_points(spark, sf_dir, kinds=("set_origin", "rel_point")):
    o = V.v_ops(spark, sf_dir).where(F.col("op").isin(*kinds))
    kind = F.when(F.col("op") == "set_origin", "origin").when(F.col("op") == "rel_point", "rel").otherwise("rel_center")
    at = lambda p, d: F.when(F.col("op") == "set_origin", p).otherwise(d)
    return o.select("drawing_id", "seq", F.lit(0).alias("pt"), "op", kind.alias("kind"), at(F.col("a"), F.col("dx")).alias("x"), at(-F.col("a"), F.col("dy")).alias("y"))


@query("SELECT drawing_id, seq, ax, ay FROM pen WHERE op IN ('set_origin', 'rel_point')", OPS, ABS_SQL)
def w1_to_absolute(spark, sf_dir):
    return ST.to_absolute(pen_points(spark, sf_dir)).select("drawing_id", "seq", "ax", "ay")


@query("SELECT drawing_id, seq, ax, ay FROM pen WHERE op IN ('set_origin', 'rel_point')", OPS, ABS_SQL)
def w1_to_absolute_chunked(spark, sf_dir):
    return ST.to_absolute(pen_points(spark, sf_dir), chunk=16).select("drawing_id", "seq", "ax", "ay")


@query("SELECT drawing_id, seq, CAST(sum(mx) OVER w AS BIGINT) AS ax, CAST(sum(my) OVER w AS BIGINT) AS ay FROM (SELECT drawing_id, seq, seg, CASE WHEN op = 'set_attr' THEN dx ELSE mx END AS mx, CASE WHEN op = 'set_attr' THEN dy ELSE my END AS my FROM moved JOIN v_ops USING (drawing_id, seq, op) WHERE op IN ('set_origin', 'rel_point', 'set_attr')) WINDOW w AS (PARTITION BY drawing_id, seg ORDER BY seq ROWS UNBOUNDED PRECEDING)", OPS, ABS_SQL)
def w2_centre_pen(spark, sf_dir):
    return ST.to_absolute(pen_points(spark, sf_dir, ("set_origin", "rel_point", "set_attr")), centers=True).select("drawing_id", "seq", "ax", "ay")


@query("SELECT drawing_id, shape_id, pt, x - min(x) OVER (PARTITION BY drawing_id) AS x, y - min(y) OVER (PARTITION BY drawing_id) AS y FROM v_pts", PTS)
def w3_to_origin(spark, sf_dir):
    return G.to_origin(V.v_pts(spark, sf_dir)).select("drawing_id", "shape_id", "pt", "x", "y")


@query("SELECT drawing_id, seq, coalesce(last_value(CASE WHEN op = 'set_attr' THEN a END IGNORE NULLS) OVER w, 0) AS colour, coalesce(last_value(CASE WHEN op = 'set_attr' AND k % 2 = 0 THEN k END IGNORE NULLS) OVER w, -1) AS width FROM v_ops WINDOW w AS (PARTITION BY drawing_id ORDER BY seq ROWS UNBOUNDED PRECEDING)", OPS)
def w4_carry_state(spark, sf_dir):
    o = V.v_ops(spark, sf_dir).select("drawing_id", "seq", F.when(F.col("op") == "set_attr", F.col("a")).alias("colour"), F.when((F.col("op") == "set_attr") & (F.col("k") % 2 == 0), F.col("k")).alias("width"))
    return ST.carry_state(o, {"colour": 0, "width": -1})


SCOPE_SQL = """e AS (SELECT *, sum(CASE WHEN op = 'reset_state' THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM v_ops),
 r AS (SELECT *, sum(CASE op WHEN 'save_state' THEN 1 WHEN 'restore_state' THEN -1 ELSE 0 END) OVER (PARTITION BY drawing_id, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM e),
 m AS (SELECT *, least(0, min(s) OVER (PARTITION BY drawing_id, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS low FROM r),
 d AS (SELECT *, CAST(s - low AS BIGINT) AS depth FROM m),
 lv AS (SELECT d.*, CAST(unnest(range(0, depth + 1)) AS BIGINT) AS level FROM d),
 lw AS (SELECT *, last_value(CASE WHEN op = 'save_state' AND depth = level THEN seq END IGNORE NULLS) OVER v AS opened, last_value(CASE WHEN op = 'save_state' AND depth = level THEN k END IGNORE NULLS) OVER v AS opener,
  last_value(CASE WHEN op = 'set_attr' AND depth = level THEN seq END IGNORE NULLS) OVER v AS set_at, last_value(CASE WHEN op = 'set_attr' AND depth = level THEN a END IGNORE NULLS) OVER v AS set_value,
  last_value(CASE WHEN op = 'save_state' AND depth = level AND k % 3 = 0 THEN seq END IGNORE NULLS) OVER v AS m_at FROM lv WINDOW v AS (PARTITION BY drawing_id, epoch, level ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def scoped(spark, sf_dir):
    scope = F.when(F.col("op") == "save_state", "save").when(F.col("op") == "restore_state", "restore").when(F.col("op") == "reset_state", "reset")
    return V.v_ops(spark, sf_dir).withColumn("scope", scope)


@query("SELECT drawing_id, seq, max(depth) AS depth, coalesce(arg_max(CASE WHEN opened IS NULL OR set_at > opened THEN set_value END, CASE WHEN opened IS NULL OR set_at > opened THEN set_at END), -1) AS colour FROM lw GROUP BY 1, 2", OPS, SCOPE_SQL)
def w5_carry_scoped(spark, sf_dir):
    o = scoped(spark, sf_dir).withColumn("colour", F.when(F.col("op") == "set_attr", F.col("a")))
    return ST.carry_scoped(o, "colour", -1).withColumn("depth", F.col("depth").cast("long"))


@query("""SELECT drawing_id, count(*) FILTER (op = 'save_state') AS saves, count(*) FILTER (op = 'restore_state') AS restores, CAST(sum(under) AS BIGINT) AS underflows, CAST(sum(CASE WHEN last THEN depth ELSE 0 END) AS BIGINT) AS unmatched, max(depth) AS max_depth
FROM (SELECT *, coalesce(lag(low) OVER w, 0) - low AS under, lead(seq) OVER w IS NULL AS last FROM d WINDOW w AS (PARTITION BY drawing_id, epoch ORDER BY seq)) GROUP BY 1""", OPS, SCOPE_SQL)
def w6_stack_audit(spark, sf_dir):
    return ST.stack_audit(scoped(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("unmatched", "max_depth")})


@query("SELECT drawing_id, seq, CASE WHEN seg > 0 THEN CAST(sum(step) OVER (PARTITION BY drawing_id, seg ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS node FROM (SELECT drawing_id, seq, sum(CASE WHEN op = 'set_origin' THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seg, CASE op WHEN 'set_origin' THEN a WHEN 'rel_point' THEN dx WHEN 'set_attr' THEN 1 ELSE 0 END AS step FROM v_ops)", OPS)
def w7_node_numbers(spark, sf_dir):
    kind = F.when(F.col("op") == "set_origin", "base").when(F.col("op") == "rel_point", "delta").when(F.col("op") == "set_attr", "auto")
    o = V.v_ops(spark, sf_dir).select("drawing_id", "seq", kind.alias("kind"), F.when(F.col("op") == "set_origin", F.col("a")).otherwise(F.col("dx")).alias("value"))
    return ST.node_numbers(o).select("drawing_id", "seq", "node")


@query("SELECT drawing_id, seq, coalesce(string_agg('g' || opener, '/' ORDER BY level) FILTER (level > 0), '') AS path FROM lw GROUP BY 1, 2", OPS, SCOPE_SQL)
def w8_group_path(spark, sf_dir):
    return ST.group_path(scoped(spark, sf_dir).withColumn("name", F.concat(F.lit("g"), F.col("k").cast("string"))), "name")


@query("SELECT * FROM (SELECT drawing_id, shape_id, pt, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2 FROM v_pts WINDOW w AS (PARTITION BY drawing_id, shape_id ORDER BY pt)) WHERE x2 IS NOT NULL", PTS)
def w9_triangles(spark, sf_dir):
    return G.triangles(V.v_pts(spark, sf_dir))


@query("SELECT drawing_id, shape_id, (pt - 1) // 3 AS curve, " + ", ".join(f"max({c}) FILTER ((pt - 1) % 3 = {k}) AS {c}{k + 1}" for k in range(3) for c in "xy") + " FROM v_pts WHERE pt >= 1 GROUP BY ALL HAVING count(*) = 3", PTS)
def w10_bezier_groups(spark, sf_dir):
    return G.bezier_groups(V.v_pts(spark, sf_dir))


@query("SELECT * FROM (SELECT drawing_id, shape_id, pt, x, y, coalesce(lead(x) OVER w, CASE WHEN shape_id % 2 = 0 THEN first_value(x) OVER w END) AS to_x, coalesce(lead(y) OVER w, CASE WHEN shape_id % 2 = 0 THEN first_value(y) OVER w END) AS to_y FROM v_pts WINDOW w AS (PARTITION BY drawing_id, shape_id ORDER BY pt)) WHERE to_x IS NOT NULL", PTS)
def w11_segments(spark, sf_dir):
    return G.segments(V.v_pts(spark, sf_dir), F.col("shape_id") % 2 == 0)


@query("SELECT * FROM (SELECT file, type, n, CAST(floor(100.0 * n / sum(n) OVER (PARTITION BY file) * 1000 + 0.5) AS BIGINT) AS percent, row_number() OVER (PARTITION BY file ORDER BY n DESC, type) AS rank FROM (SELECT file, type, count(*) AS n FROM v_types GROUP BY ALL)) WHERE rank <= 3", TYPES)
def w12_rank_types(spark, sf_dir):
    return D.rank_types(V.v_types(spark, sf_dir), 3).withColumns({"percent": q(F.col("percent")), "rank": F.col("rank").cast("long")})


@query("""SELECT drawing_id, shape_id, pt, cmd, CASE WHEN cmd = 'Z' THEN last_value(CASE WHEN cmd IN ('M', 'm') THEN x END IGNORE NULLS) OVER w ELSE x END AS x, CASE WHEN cmd = 'Z' THEN last_value(CASE WHEN cmd IN ('M', 'm') THEN y END IGNORE NULLS) OVER w ELSE y END AS y
FROM (SELECT *, CAST(sum(CASE WHEN cmd IN ('v', 'Z') THEN 0 ELSE px END) OVER (PARTITION BY drawing_id, shape_id, sx ORDER BY pt) AS BIGINT) AS x, CAST(sum(CASE WHEN cmd IN ('H', 'h', 'Z') THEN 0 ELSE py END) OVER (PARTITION BY drawing_id, shape_id, sy ORDER BY pt) AS BIGINT) AS y
 FROM (SELECT *, count(*) FILTER (cmd IN ('M', 'L', 'H')) OVER w AS sx, count(*) FILTER (cmd IN ('M', 'L')) OVER w AS sy
  FROM (SELECT drawing_id, shape_id, pt, cmd, x AS px, y AS py FROM v_cmds UNION ALL SELECT drawing_id, shape_id, 32, 'Z', 0, 0 FROM v_cmds WHERE pt = 0) WINDOW w AS (PARTITION BY drawing_id, shape_id ORDER BY pt)))
 WINDOW w AS (PARTITION BY drawing_id, shape_id ORDER BY pt)""", PATHS)
def w13_path_vertices(spark, sf_dir):
    return ST.path_vertices(V.v_paths(spark, sf_dir)).select("drawing_id", "shape_id", F.col("pt").cast("long").alias("pt"), "cmd", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("SELECT page_id % 10 AS file, page_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY url, page_id) - 1 AS index, row_number() OVER (PARTITION BY page_id % 10 ORDER BY url, page_id) > 1 AS break_before FROM pages")
def w14_page_index(spark, sf_dir):
    p = V.read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("file"), "page_id", F.struct("url", "page_id").alias("path"))
    return ST.page_index(p).select("file", "page_id", F.col("index").cast("long").alias("index"), "break_before")


@query("SELECT drawing_id, seq, max(depth) AS depth, max(CASE WHEN level > 0 AND m_at >= opened THEN m_at END) AS matrix FROM lw GROUP BY 1, 2", OPS, SCOPE_SQL)
def w15_inherit_matrix(spark, sf_dir):
    # A canvas stands for its place here; one in three has a matrix. An opener's own matrix counts inside it.
    o = scoped(spark, sf_dir).withColumn("matrix", F.when((F.col("scope") == "save") & (F.col("k") % 3 == 0), F.col("seq")))
    return ST.inherit_matrix(o).withColumn("depth", F.col("depth").cast("long"))


@query("""SELECT drawing_id, seq, CAST(2 ** count(i) AS BIGINT) AS a, CAST(sum(CASE WHEN i IS NULL THEN 0 ELSE opener * 2 ** (i - 1) END) AS BIGINT) AS e FROM (
 SELECT drawing_id, seq, opener, CASE WHEN level > 0 AND opener % 3 <> 0 THEN count(*) FILTER (level > 0 AND opener % 3 <> 0) OVER (PARTITION BY drawing_id, seq ORDER BY level) END AS i FROM lw) GROUP BY 1, 2""", OPS, SCOPE_SQL)
def w15_composed_matrix(spark, sf_dir):
    # Two canvases in three double and move by their number; what no canvas holds has the unit matrix.
    k = F.col("k").cast("double")
    o = scoped(spark, sf_dir).withColumn("matrix", F.when((F.col("scope") == "save") & (F.col("k") % 3 != 0), F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), k, F.lit(0.0))))
    m = ST.inherit_matrix(o, compose=True)
    at = lambda i, d: F.coalesce(F.get("matrix", F.lit(i)), F.lit(d)).cast("long")
    return m.select("drawing_id", "seq", at(0, 1.0).alias("a"), at(4, 0.0).alias("e"))


# Sorts, limits, top-k


@query("SELECT type, count(*) AS n FROM v_types GROUP BY 1 ORDER BY n DESC, type LIMIT 3", TYPES)
def l1_top_types(spark, sf_dir):
    return D.top_types(V.v_types(spark, sf_dir), 3)


@query("SELECT file, type, seq FROM (SELECT *, row_number() OVER (PARTITION BY file, type ORDER BY seq) AS r FROM v_types) WHERE r <= 10", TYPES)
def l2_sample_first(spark, sf_dir):
    return D.sample_first(V.v_types(spark, sf_dir), 10, ["file", "type"]).select("file", "type", "seq")


@query("SELECT drawing_id, seq, op FROM v_ops WHERE seq <= 20", OPS)
def l3_cap_ops(spark, sf_dir):
    return D.cap_ops(V.v_ops(spark, sf_dir), 20).select("drawing_id", "seq", "op")


@query("SELECT DISTINCT type, file FROM v_types ORDER BY type, file", TYPES)
def l4_ordered(spark, sf_dir):
    return D.ordered(V.v_types(spark, sf_dir).select("type", "file").distinct(), "type", "file")


@query("SELECT doc_id, left(text, 100) AS head, array_to_string(string_split(text, ' ')[1:20], ' ') AS names FROM documents")
def l5_head_list(spark, sf_dir):
    return V.read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("head"), F.array_join(D.head_list(F.split("text", " "), 20), " ").alias("names"))


# Sets


@query("SELECT file, seq, type, CAST(seq % 2 AS INTEGER) AS stream, CASE WHEN seq % 2 = 0 THEN size END AS size FROM v_types", TYPES)
def u1_union_ops(spark, sf_dir):
    t = V.v_types(spark, sf_dir)
    return D.union_ops([t.where("seq % 2 = 0"), t.where("seq % 2 = 1").drop("size")]).select("file", "seq", "type", "stream", "size")


@query("SELECT DISTINCT type FROM v_types", TYPES)
def u2_all_types(spark, sf_dir):
    t = V.v_types(spark, sf_dir)
    return D.all_types([t.where("file % 2 = 0"), t.where("file % 2 = 1")])


def _halves(spark, sf_dir):
    t = V.v_types(spark, sf_dir).withColumn("type", F.concat("type", F.lit("/"), (F.col("size") % 500).cast("string")))
    return t.where("file % 2 = 0"), t.where("file % 2 = 1")


HALVES = "h AS (SELECT file, type || '/' || (size % 500) AS type FROM v_types)"


@query("SELECT type FROM h WHERE file % 2 = 0 INTERSECT SELECT type FROM h WHERE file % 2 = 1", TYPES, HALVES)
def u3_shared_types(spark, sf_dir):
    return D.shared_types(*_halves(spark, sf_dir))


@query("SELECT type FROM h WHERE file % 2 = 0 EXCEPT SELECT type FROM h WHERE file % 2 = 1", TYPES, HALVES)
def u4_only_in(spark, sf_dir):
    return D.only_in(*_halves(spark, sf_dir))


# Scalar functions


@query("SELECT drawing_id, shape_id, pt, CAST(floor(x * 0.1 * 1000 + 0.5) AS BIGINT) AS px, CAST(floor((792 - y * 0.1) * 1000 + 0.5) AS BIGINT) AS py FROM v_pts", PTS)
def f1_place(spark, sf_dir):
    x, y = S.place(F.col("x"), F.col("y"), 0.1, True, 792)
    return V.v_pts(spark, sf_dir).select("drawing_id", "shape_id", "pt", q(x).alias("px"), q(y).alias("py"))


@query("SELECT id, CAST(floor(least(CASE WHEN width = 0 THEN NULL ELSE 540.0 / width END, 720.0 / height) * 1000000 + 0.5) AS BIGINT) AS scale FROM v_dims", DIMS)
def f2_fit_scale(spark, sf_dir):
    return V.v_dims(spark, sf_dir).select("id", q(S.fit_scale(F.col("width"), F.col("height"), 612.0, 792.0), 1000000).alias("scale"))


@query("SELECT id, CAST(CASE id % 3 WHEN 0 THEN 595 WHEN 1 THEN least(width * 2 + 72, 1224) ELSE 842 END AS BIGINT) AS w, CAST(CASE id % 3 WHEN 0 THEN 842 WHEN 1 THEN least(height * 2 + 72, 1224) ELSE 1191 END AS BIGINT) AS h FROM v_dims", DIMS)
def f3_page_size(spark, sf_dir):
    kind = F.get(F.array(F.lit("A4"), F.lit("auto"), F.lit("A3")), (F.col("id") % 3).cast("int"))
    w, h = S.page_size(kind, F.col("width"), F.col("height"), 2, 1224.0)
    return V.v_dims(spark, sf_dir).select("id", w.cast("long").alias("w"), h.cast("long").alias("h"))


@query("SELECT id, CAST(floor(width * (1.0 / 72) * 1000 + 0.5) AS BIGINT) AS inches, CAST(floor(height * 0.75 * 1000 + 0.5) AS BIGINT) AS points FROM v_dims", DIMS)
def f4_convert_units(spark, sf_dir):
    return V.v_dims(spark, sf_dir).select("id", q(S.convert_units(F.col("width"), "point", "inch")).alias("inches"), q(S.convert_units(F.col("height"), "px96", "point")).alias("points"))


@query("SELECT id, CASE WHEN p < 1 THEN 'match' WHEN p < 5 THEN 'close' ELSE 'mismatch' END AS match FROM (SELECT id, 100 * abs(width / height - 612.0 / 792) / (612.0 / 792) AS p FROM v_dims)", DIMS)
def f5_aspect_match(spark, sf_dir):
    return V.v_dims(spark, sf_dir).select("id", S.aspect_match(S.aspect(F.col("width"), F.col("height")), F.lit(612.0) / 792).alias("match"))


@query("SELECT drawing_id, shape_id, pt, 2 * x - y + 10 AS mx, x + 3 * y - 5 AS my FROM v_pts", PTS)
def f6_affine(spark, sf_dir):
    x, y = S.affine(F.col("x"), F.col("y"), F.array(*map(F.lit, (2.0, 1.0, -1.0, 3.0, 10.0, -5.0))))
    return V.v_pts(spark, sf_dir).select("drawing_id", "shape_id", "pt", x.cast("long").alias("mx"), y.cast("long").alias("my"))


@query("SELECT drawing_id, shape_id, pt, CASE WHEN (shape_id + pt) % 3 > 0 THEN x || ',0,' || pt || ',1,-' || pt || ',' || y END AS matrix FROM v_pts", PTS)
def f7_parse_matrix(spark, sf_dir):
    p = V.v_pts(spark, sf_dir)
    text = F.when((F.col("shape_id") + F.col("pt")) % 3 == 0, F.concat_ws(",", "x", "y")).otherwise(F.concat(F.col("x").cast("string"), F.lit(", 0,"), F.col("pt").cast("string"), F.lit(", 1,-"), F.col("pt").cast("string"), F.lit(" ,"), F.col("y").cast("string")))
    # -0 and 0 are the same number, written alike here and there.
    numbers = F.transform(S.parse_matrix(text), lambda v: v.cast("long").cast("string"))
    shown = F.array_join(F.transform(numbers, lambda v, i: F.when((i == 4) & (v == "0"), "-0").otherwise(v)), ",")
    return p.select("drawing_id", "shape_id", "pt", shown.alias("matrix"))


@query("""SELECT drawing_id, shape_id, md5(string_agg(CASE WHEN cmd IN ('M', 'L') THEN cmd || printf('%.2f', 2.0 * x - y + 10) || ',' || printf('%.2f', x + 3.0 * y - 5) WHEN cmd = 'H' THEN cmd || printf('%.2f', 2.0 * x + 10)
 ELSE cmd || ' ' || CASE cmd WHEN 'v' THEN CAST(y AS VARCHAR) WHEN 'h' THEN CAST(x AS VARCHAR) ELSE x || ',' || y END END, ' ' ORDER BY pt) || ' Z') AS path FROM v_cmds GROUP BY ALL""", PATHS)
def f8_transform_path(spark, sf_dir):
    m = F.array(*map(F.lit, (2.0, 1.0, -1.0, 3.0, 10.0, -5.0)))
    return V.v_paths(spark, sf_dir).select("drawing_id", "shape_id", F.md5(S.transform_path(F.col("data"), m)).alias("path"))


HEX_SQL = "hx AS (SELECT p_partkey, md5(p_name) AS h FROM part)"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ('0x' || substr(h, 3, 2))::BIGINT WHEN 2 THEN ('0x' || substr(h, 1, 2))::BIGINT ELSE 0 END AS r, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ('0x' || substr(h, 1, 2))::BIGINT ELSE 255 END AS a FROM hx""", HEX_SQL)
def f9_parse_colour(spark, sf_dir):
    h = F.md5("p_name")
    text = F.get(F.array(F.lit("transparent"), F.concat(F.lit("#"), F.substring(h, 1, 8)), F.concat(F.lit("#"), F.upper(F.substring(h, 1, 6))), F.lit("#12")), (F.col("p_partkey") % 4).cast("int"))
    c = S.parse_colour(text)
    return V.read(spark, sf_dir, "part").select("p_partkey", c["r"].cast("long").alias("r"), c["a"].cast("long").alias("a"))


@query("SELECT p_partkey, '#' || printf('%02x', (v & 255)) || printf('%02x', ((v >> 8) & 255)) || printf('%02x', ((v >> 16) & 255)) AS hex, ((v >> 8) & 255) AS red, CAST(trunc((v % 1000) / 1000.0 * 255) AS INTEGER) AS byte FROM (SELECT p_partkey, p_partkey * 7919 AS v FROM part)")
def f10_colour_packing(spark, sf_dir):
    v = F.col("p_partkey") * 7919
    u = S.unpack_colour(v)
    return V.read(spark, sf_dir, "part").select("p_partkey", S.rgb_hex(u["r"], u["g"], u["b"]).alias("hex"), S.bgra_to_rgb(v)["r"].alias("red"), S.to_byte((v % 1000) / 1000).alias("byte"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, (v & 65535) AS w, ((v >> 16) & 65535) AS h, CASE WHEN ((v >> 16) & 65535) = 0 OR (v & 65535) = ((v >> 16) & 65535) THEN 'circle' ELSE 'ellipse' END AS kind, (v & 65535) | (((v >> 16) & 65535) << 16) AS packed FROM (SELECT *, l_orderkey * 12 AS v FROM lineitem)")
def f11_dims(spark, sf_dir):
    w, h = S.unpack_dims(F.col("l_orderkey") * 12)
    return V.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), w.alias("w"), h.alias("h"), S.shape_kind(w, h).alias("kind"), S.pack_dims(w, h).alias("packed"))


@query("SELECT drawing_id, seq, CAST(floor(a * 360.0 / 65536 * 1000 + 0.5) AS BIGINT) AS degrees, ((-a % 360) + 360) % 360 AS norm, (((dx - dy) % 65536) + 65536) % 65536 = 0 AS full_circle FROM v_ops", OPS)
def f12_angles(spark, sf_dir):
    a = F.col("a")
    return V.v_ops(spark, sf_dir).select("drawing_id", "seq", q(S.to_degrees(a)).alias("degrees"), S.norm_degrees(-a).alias("norm"), S.is_full_circle(F.col("dy"), F.col("dx")).alias("full_circle"))


@query("SELECT drawing_id, seq, CASE WHEN a * 400000 > 2000000000 THEN a * 400000 - 4294967296 ELSE a * 400000 END AS v FROM v_ops", OPS)
def f13_unwrap32(spark, sf_dir):
    return V.v_ops(spark, sf_dir).select("drawing_id", "seq", S.unwrap32(F.col("a") * 400000).alias("v"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS unix, (epoch_us(o_orderdate) + 11644473600000000) * 10 AS filetime, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS parsed FROM orders")
def f14_timestamps(spark, sf_dir):
    t = F.col("o_orderdate").cast("timestamp")
    ft = S.to_filetime(t)
    back = S.from_filetime(ft.bitwiseAND(0xFFFFFFFF), F.shiftright(ft, 32))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format(t, "MM/dd/yyyy HH:mm:ss")).otherwise("no time")
    return V.read(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(back).alias("unix"), ft.alias("filetime"), F.unix_seconds(S.parse_ts(text)).alias("parsed"))


@query("SELECT p_partkey, '{' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '}' AS guid, h AS parsed FROM hx", HEX_SQL)
def f15_guid(spark, sf_dir):
    g = S.format_guid(F.md5("p_name"))
    return V.read(spark, sf_dir, "part").select("p_partkey", g.alias("guid"), S.parse_guid(g).alias("parsed"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, v & 255 AS u8, CASE WHEN (v & 65535) >= 32768 THEN (v & 65535) - 65536 ELSE v & 65535 END AS i16, v AS u32 FROM (SELECT *, (l_orderkey * 40503 + l_linenumber) % 4294967296 AS v FROM lineitem)")
def f16_decode_fixed(spark, sf_dir):
    v = (F.col("l_orderkey") * 40503 + F.col("l_linenumber")) % 4294967296
    h = F.lpad(F.hex(v), 8, "0")
    data = F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))
    d = S.decode_fixed(F.concat(data, F.substring(data, 1, 2), F.substring(data, 1, 1)), [("u32", "u32"), ("i16", "i16"), ("u8", "u8")])
    return V.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), d["u8"].alias("u8"), d["i16"].alias("i16"), d["u32"].alias("u32"))


@query("""SELECT drawing_id, shape_id, CAST(pt AS BIGINT) AS pt, x % 30000 AS x, y % 30000 AS y, NULL AS error FROM v_pts WHERE shape_id % 7 > 1
UNION ALL SELECT drawing_id, shape_id, NULL, NULL, NULL, CASE shape_id % 7 WHEN 0 THEN 'expected ' || n || ' bytes, found ' || (n - 1) ELSE 'no whole count' END FROM (SELECT *, CASE shape_id % 3 WHEN 0 THEN 3 + 288 * 4 WHEN 1 THEN 3 + 32 * 8 ELSE 5 + 32 * 4 END AS n FROM v_pts WHERE pt = 0) WHERE shape_id % 7 <= 1
UNION ALL SELECT drawing_id, shape_id, i, 0, i, NULL FROM v_pts, (SELECT unnest(range(32, 288)) AS i) WHERE pt = 0 AND shape_id % 7 > 1 AND shape_id % 3 = 0""", PTS)
def f16_point_records(spark, sf_dir):
    # Records of the points of shapes in three encodings, all with an extended count; those of the first kind are filled up to 288 points. One in seven lacks its last byte, one its count's.
    low = lambda v, n: F.unhex(F.concat(*[F.substring(F.right(F.hex(v), F.lit(2 * n)), 2 * n - 1 - 2 * k, 2) for k in range(n)]))
    wide = lambda v, n: low(v + 2**40, n)
    each = lambda n: F.unhex(F.array_join(F.transform("p", lambda p: F.concat(F.hex(wide(p["x"] % 30000, n)), F.hex(wide(p["y"] % 30000, n)))), ""))
    more = F.unhex(F.array_join(F.transform(F.sequence(F.lit(32).cast("long"), F.lit(287).cast("long")), lambda i: F.concat(F.lit("0000"), F.hex(wide(i, 2)))), ""))
    kind = F.col("shape_id") % 3
    data = F.when(kind == 0, F.concat(F.unhex(F.lit("002000")), each(2), more)).when(kind == 1, F.concat(F.unhex(F.lit("FF2000")), each(4))).otherwise(F.concat(F.unhex(F.lit("FF20000000")), each(2)))
    data = F.when(F.col("shape_id") % 7 == 0, F.substring(data, F.lit(1), F.length(data) - 1)).when(F.col("shape_id") % 7 == 1, F.substring(data, 1, 2)).otherwise(data)
    # The bytes are made once, not for each of their uses.
    d = cut(V.v_shapes(spark, sf_dir).select("drawing_id", "shape_id", kind.alias("kind"), data.alias("data")))
    r = F.when(F.col("kind") == 0, S.decode_points(F.col("data"), *S.POINT_RECORDS[0x10])).when(F.col("kind") == 1, S.decode_points(F.col("data"), *S.POINT_RECORDS[0x70])).otherwise(S.decode_points(F.col("data"), "ff_i32"))
    rows = d.select("drawing_id", "shape_id", r.alias("r"))
    good = rows.where("r.error is null").select("drawing_id", "shape_id", F.posexplode("r.points").alias("pt", "p"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("long")
    return good.select("drawing_id", "shape_id", F.col("pt").cast("long").alias("pt"), "p.x", "p.y", "error").union(rows.where("r.error is not null").select("drawing_id", "shape_id", none, none, none, "r.error"))


@query("""SELECT drawing_id, shape_id, kind, CASE WHEN e IS NULL THEN n END AS n, CASE WHEN e IS NULL THEN CAST(total AS BIGINT) END AS total, e AS error FROM (
SELECT drawing_id, shape_id, kind, 64 AS n, sx + sy AS total, CASE v WHEN 1 THEN 'Vertex count mismatch: expected 33 vertices, found 32' WHEN 2 THEN CASE kind WHEN 'polyline' THEN 'Invalid vertex count: 0. Must be at least 1.' ELSE 'Invalid vertex count: 0. Polytriangle requires at least 3 vertices.' END
  WHEN 3 THEN 'Invalid ASCII ' || kind || ' format: expected vertex count, got: ' || t END AS e
 FROM (SELECT drawing_id, shape_id, shape_id % 4 AS v, sum(x) AS sx, sum(y) AS sy, string_agg('(' || x || ', ' || y || ')', ' ' ORDER BY pt) AS t FROM v_pts GROUP BY ALL), (VALUES ('polyline'), ('polytriangle')) k(kind)
UNION ALL SELECT drawing_id, shape_id, kind, CASE kind WHEN 'circle' THEN 3 ELSE 4 END, x0 + y0 + CASE kind WHEN 'line' THEN x1 + y1 WHEN 'circle' THEN x1 ELSE x1 + y1 END,
  CASE kind WHEN 'line' THEN CASE WHEN v = 3 THEN 'Invalid ASCII line format: expected ''(x1,y1)(x2,y2)'', got: ' || x0 || ' ' || y0 END
   WHEN 'circle' THEN CASE WHEN v = 3 THEN 'Invalid ASCII circle format: expected ''(x,y) radius'', got: ' || x0 || ' ' || y0 WHEN x1 < 0 THEN 'Invalid radius: ' || x1 || '. Radius must be non-negative.' END
   ELSE CASE WHEN v = 3 THEN 'Invalid ASCII ellipse format: expected ''(x,y) major,minor'', got: ' || x0 || ' ' || y0 WHEN x1 < 0 OR y1 < 0 THEN 'Invalid axes: major=' || x1 || ', minor=' || y1 || '. Axes must be non-negative.' END END
 FROM (SELECT drawing_id, shape_id, (shape_id + pt) % 4 AS v, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v_pts WINDOW w AS (PARTITION BY drawing_id, shape_id ORDER BY pt)), (VALUES ('line'), ('circle'), ('ellipse')) k(kind) WHERE x1 IS NOT NULL)""", PTS)
def f17_ascii_geometry(spark, sf_dir):
    # All points of a shape as counted texts, right or not, and each of its segments as a line, circle and ellipse.
    t = lambda c: c.cast("string")
    pick = lambda v, *xs: F.get(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), v.cast("int"))
    points = F.array_join(F.transform("p", lambda p: F.concat(F.lit("("), t(p["x"]), F.lit(", "), t(p["y"]), F.lit(")"))), " ")
    counted = V.v_shapes(spark, sf_dir).select("drawing_id", "shape_id", F.concat(pick(F.col("shape_id") % 4, " 32 ", "33 ", "0 ", ""), points).alias("line"))
    pair = F.concat(F.lit("( "), t(F.col("x")), F.lit(","), t(F.col("y")), F.lit(" )"))
    v, bare = (F.col("shape_id") + F.col("pt")) % 4 == 3, F.concat(F.lit(" "), t(F.col("x")), F.lit(" "), t(F.col("y")))
    each = G.segments(V.v_pts(spark, sf_dir)).select("drawing_id", "shape_id", *[F.when(v, bare).otherwise(F.concat(pair, rest)).alias(k) for k, rest in (
        ("line", F.concat(F.lit("("), t(F.col("to_x")), F.lit(" ,"), t(F.col("to_y")), F.lit(")"))), ("circle", F.concat(F.lit("  "), t(F.col("to_x")))), ("ellipse", F.concat(F.lit(" "), t(F.col("to_x")), F.lit(" , "), t(F.col("to_y")))))])
    got = lambda df, kind, c: df.select("drawing_id", "shape_id", F.lit(kind).alias("kind"), S.parse_ascii_geom(kind, F.col(c)).alias("g")).select("drawing_id", "shape_id", "kind", F.size("g.values").alias("n"), F.aggregate("g.values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("g.error").alias("error"))
    rows = [got(counted, k, "line") for k in ("polyline", "polytriangle")] + [got(each, k, k) for k in ("line", "circle", "ellipse")]
    return D.reduce(DataFrame.union, rows).withColumn("n", F.nullif(F.col("n"), F.lit(-1)))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN p_size % 2 = 0 END AS show, CASE WHEN p_size % 5 < 4 THEN (p_size % 4) * 90 END AS rotation, CASE WHEN p_size % 5 < 4 THEN p_size + 0.5 END AS width, CASE WHEN p_size % 5 < 4 THEN 4 END AS area, CASE WHEN p_size % 5 < 4 THEN p_size END AS tx,
 CASE WHEN p_size % 3 = 0 THEN p_name END AS unit, CASE WHEN p_size % 3 > 0 THEN p_size END AS inked, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 2 * p_size END AS view_x, CASE WHEN p_size % 2 = 1 THEN p_name END AS view_name, 3 - p_size AS named_y, p_brand AS named FROM part""")
def f18_parse_meta(spark, sf_dir):
    z, t = F.col("p_size"), lambda c: c.cast("string")
    plot = S.parse_meta("PlotInfo", F.concat_ws(" ", F.when(z % 2 == 0, "Show").otherwise("hide"), t((z % 4) * 90), F.when(z % 5 < 4, "mm").otherwise("feet"), F.concat(t(z), F.lit(".5")), F.lit("20 0 0 5 6 1 0 0 1"), t(z), F.lit("0)")))
    units = S.parse_meta("Units", F.concat(F.lit('"'), F.col("p_name"), F.lit('" 1 0 0 1 0'), F.when(z % 3 == 0, " 7)").otherwise(")")))
    area = S.parse_meta("InkedArea", F.concat(F.lit("("), t(z), F.lit(", 1) (2,3)(4 ,5)"), F.when(z % 3 > 0, " (6,7))").otherwise(")")))
    name = S.parse_meta("SourceFilename", F.concat(F.lit(' "'), F.col("p_name"), F.lit('")')))
    view = S.parse_meta("View", F.when(z % 2 == 0, F.concat(F.lit(" -1,-2 "), t(2 * z), F.lit(" , 9)"))).otherwise(F.concat(F.lit(" '"), F.col("p_name"), F.lit("' )"))))
    named = S.parse_meta("NamedView", F.concat(F.lit(" 1,"), t(3 - z), F.lit(" 4,5 '"), F.col("p_brand"), F.lit("')")))
    # Each text is parsed in a column of its own, from which fields are taken.
    parsed = V.read(spark, sf_dir, "part").select("p_partkey", plot.alias("plot"), units.alias("units"), area.alias("area"), name.alias("name"), view.alias("view"), named.alias("named"))
    plot, units, area, view, named = (F.col(c) for c in ("plot", "units", "area", "view", "named"))
    return parsed.select(
        "p_partkey", plot["show"].alias("show"), plot["rotation"].cast("int").alias("rotation"), plot["width"].alias("width"), F.nullif(F.size(plot["area"]), F.lit(-1)).alias("area"), plot["matrix"][4].cast("int").alias("tx"),
        units["name"].alias("unit"), area[0]["x"].cast("int").alias("inked"), "name", view["box"][2].cast("int").alias("view_x"), view["name"].alias("view_name"), named["box"][1].cast("int").alias("named_y"), named["name"].alias("named"),
    )


@query("SELECT doc_id, CAST(len(n) // 2 AS BIGINT) AS pairs, md5(coalesce(array_to_string(list_transform(range(1, len(n) // 2 * 2 + 1), lambda i: CASE WHEN abs(CAST(n[i] AS DOUBLE)) < 1e14 THEN CAST(CAST(floor(CAST(n[i] AS DOUBLE) * 2 * 1000 + 0.5) AS BIGINT) AS VARCHAR) ELSE 'large' END), ','), '')) AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '[-+]?[0-9]*\\.?[0-9]+') AS n FROM documents)")
def f19_number_pairs(spark, sf_dir):
    p = S.number_pairs(F.coalesce("text", F.lit("")), 2.0)
    d = V.read(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("pairs"), F.md5(F.array_join(F.flatten(F.transform("p", lambda v: F.array(whole(v["x"]), whole(v["y"])))), ",")).alias("numbers"))


@query("SELECT drawing_id, shape_id, pt, least(x, tx) AS min_x, least(y, ty) AS min_y, greatest(x, tx) AS max_x, greatest(y, ty) AS max_y FROM (SELECT *, lead(x) OVER w AS tx, lead(y) OVER w AS ty FROM v_pts WINDOW w AS (PARTITION BY drawing_id, shape_id ORDER BY pt)) WHERE tx IS NOT NULL", PTS)
def f20_norm_box(spark, sf_dir):
    s = G.segments(V.v_pts(spark, sf_dir))
    return s.select("drawing_id", "shape_id", "pt", S.norm_box(F.col("x"), F.col("y"), F.col("to_x"), F.col("to_y")).alias("b")).select("drawing_id", "shape_id", "pt", "b.*")


@query("SELECT doc_id, CAST(floor(length(text) * 12 * 0.6 * 10 + 0.5) AS BIGINT) AS width, 12 AS height FROM documents")
def f21_text_box(spark, sf_dir):
    b = S.text_box(F.lit(0), F.lit(0), F.col("text"), F.lit(12))
    return V.read(spark, sf_dir, "documents").select("doc_id", q(b["width"], 10).alias("width"), b["height"].cast("int").alias("height"))


@query("SELECT doc_id, md5(text) AS decoded, length(text) AS n, md5(replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)')) AS escaped FROM documents")
def f22_text_hygiene(spark, sf_dir):
    # Whole texts, as UTF-16LE where their first character is a narrow one, else as UTF-8.
    raw = F.when(F.ascii("text") < 256, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8"))
    back = S.decode_text(raw)
    return V.read(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("decoded"), F.length(back).cast("long").alias("n"), F.md5(S.escape_text(F.col("text"))).alias("escaped"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size & 1 <> 0 THEN 'NONE' END, CASE WHEN p_size & 2 <> 0 THEN 'SEAL' END, CASE WHEN p_size & 4 <> 0 THEN 'STAMP' END, CASE WHEN p_size & 8 <> 0 THEN 'LABEL' END, CASE WHEN p_size & 16 <> 0 THEN 'REDLINE' END, CASE WHEN p_size & 32 <> 0 THEN 'RESERVED1' END, CASE WHEN p_size & 64 <> 0 THEN 'RESERVED2' END) AS flags FROM part")
def f23_flags(spark, sf_dir):
    return V.read(spark, sf_dir, "part").select("p_partkey", F.array_join(S.decode_flags(F.col("p_size"), S.MEANING), ",").alias("flags"))


@query("SELECT p_partkey, (p_partkey >> 8) & 255 AS major, p_partkey & 255 AS minor FROM part")
def f24_version(spark, sf_dir):
    major, minor = S.split_version(F.col("p_partkey"))
    return V.read(spark, sf_dir, "part").select("p_partkey", major.alias("major"), minor.alias("minor"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.([^.]*)$', 1)) AS suffix FROM pages")
def f25_path_names(spark, sf_dir):
    return V.read(spark, sf_dir, "pages").select("page_id", S.stem(F.col("url")).alias("stem"), S.suffix(F.col("url")).alias("suffix"))


@query("""SELECT id, i, CAST(floor((width + height * cos(radians(id % 360 * i / n))) * 100 + 0.5) AS BIGINT) AS x, CAST(floor((height * sin(radians(id % 360 * i / n))) * 100 + 0.5) AS BIGINT) AS y FROM (SELECT *, greatest(10, (id % 360) // 10) AS n FROM v_dims), LATERAL (SELECT unnest(range(0, n + 1)) AS i)""", DIMS)
def f26_arc_points(spark, sf_dir):
    pts = S.arc_points(F.col("width"), F.lit(0), F.col("height"), F.lit(0), F.col("id") % 360)
    d = V.v_dims(spark, sf_dir).select("id", F.posexplode(pts).alias("i", "p"))
    return d.select("id", F.col("i").cast("long").alias("i"), q(F.col("p.x"), 100).alias("x"), q(F.col("p.y"), 100).alias("y"))


@query("SELECT drawing_id, seq, CAST(floor(greatest(0.1, k * 0.01) * 1000 + 0.5) AS BIGINT) AS width, CASE k % 3 WHEN 0 THEN '3,3' WHEN 1 THEN '1,2' END AS dash FROM v_ops", OPS)
def f27_stroke(spark, sf_dir):
    name = F.when(F.col("k") % 3 == 0, "dashed").when(F.col("k") % 3 == 1, "dotted").otherwise("solid")
    return V.v_ops(spark, sf_dir).select("drawing_id", "seq", q(S.line_width(F.col("k"))).alias("width"), F.array_join(S.dash(name), ",").alias("dash"))


# Guarded jobs and the flagship


def _shout(row: dict) -> int:
    if row["doc_id"] % 10 == 3:
        raise ValueError("third of ten")
    return len(row["text"].upper())


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN doc_id % 10 = 3 THEN 'ValueError: third of ten' END AS error_message FROM documents")
def g1_apply_guarded(spark, sf_dir):
    return L.apply_guarded(V.read(spark, sf_dir, "documents").select("doc_id", "text"), _shout, ["doc_id"]).select("doc_id", "status", "error_message")


@query("""SELECT drawing_id, width, height, CAST(floor(scale * 1000000 + 0.5) AS BIGINT) AS scale FROM (SELECT drawing_id, max(ax) - min(ax) AS width, max(ay) - min(ay) AS height, least(540.0 / nullif(max(ax) - min(ax), 0), 720.0 / nullif(max(ay) - min(ay), 0)) AS scale
FROM pen WHERE op IN ('set_origin', 'rel_point') GROUP BY 1) ORDER BY scale, drawing_id LIMIT 10""", OPS, ABS_SQL)
def flagship_fit(spark, sf_dir):
    pts = ST.to_absolute(pen_points(spark, sf_dir)).select("drawing_id", F.col("seq").alias("shape_id"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    fit = G.bbox(pts).withColumn("s", S.fit_scale(F.col("width"), F.col("height"), 612.0, 792.0))
    return fit.orderBy(F.asc_nulls_last("s"), "drawing_id").limit(10).select("drawing_id", "width", "height", q(F.col("s"), 1000000).alias("scale"))
