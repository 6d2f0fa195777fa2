"""Package inventories, op records, page markup, descriptors, ledgers and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_matrix
from ..operators.kept import cut
from ..operators.state import running_sum

#: An op record; fields that a kind lacks are null.
POINT = "struct<x:bigint,y:bigint>"
OPS_SCHEMA = (
    "struct<opcode:bigint,opcode_name:string,opcode_hex:string,type:string,count:bigint,relative:boolean,points:array<array<bigint>>,"
    + ",".join(f"`{k}`:{POINT}" for k in ("point1", "point2", "start", "end", "center", "origin", "position"))
    + ",bytes_read:bigint,error:string,error_type:string>"
)
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
#: Pieces of a block that are summed together; a power of 2, as the numbers of rows of a split begin at a multiple of 2 ** 33.
PIECES = 1 << 15
#: First bytes of files and what they tell. Fixed values.
HEADS = [(b"(DWF V", "DWF"), (b"(W2D V", "W2D"), (b"PK", "ZIP"), (b"PAR1", "PARQUET")]


def scan_files(spark: SparkSession, path: str, glob: str = "*", content: bool = False) -> DataFrame:
    """path, name, bytes of the files that fit glob; contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    own = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), "content")
    return own if content else own.drop("content")


def sniff_format(files: DataFrame) -> DataFrame:
    """files with content -> with format, by the leading bytes; the content goes."""
    head = F.decode(F.substring("content", 1, 6), "ISO-8859-1")
    kind = F.when(head == "(DWF V", "DWF").when(head == "(W2D V", "W2D").when(head.startswith("PK"), "ZIP").when(head.startswith("PAR1"), "PARQUET")
    return files.withColumn("format", F.coalesce(kind, F.lit("error"))).drop("content")


def sniff_heads(files: DataFrame) -> DataFrame:
    """files (path and more) -> with format, by their first six bytes alone, so that files of any size can be told.

    Tasks open the paths themselves through Arrow's file systems (local, HDFS, S3, GCS), which Spark's binary source, that reads whole files, can't spare.
    A path that can't be opened is an error.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            kinds = []
            for path in b.column("path").to_pylist():
                try:
                    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                    with system.open_input_stream(inner) as f:
                        head = f.read(6)
                except (OSError, ValueError):
                    head = b""
                kinds.append(next((k for start, k in HEADS if head.startswith(start)), "error"))
            yield b.append_column("format", pa.array(kinds, pa.string()))

    files = files.drop("format")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{schema}, format string")


def explode_members(manifests: DataFrame, file: str = "file", members: str = "all_files") -> DataFrame:
    """A row for each member name of each package; separators become slashes."""
    return manifests.select(file, F.posexplode(members).alias("ordinal", "member")).withColumn("member", F.translate("member", "\\", "/"))


def _ops_texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    texts = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("file"), "value")
    return texts.withColumn("r", F.from_json("value", f"array<{OPS_SCHEMA}>"))


def read_ops_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Op records of files that hold a JSON array each, or one a line: file, seq (the place in the array), and the record's fields.

    Arrays that do not parse give no records here; malformed_ops_json lists them. An array is one row while it is parsed: large
    drawings come as several arrays, one a line.
    """
    return _ops_texts(spark, path, lines).select("file", F.posexplode("r").alias("seq", "r")).select("file", F.col("seq").cast("long").alias("seq"), "r.*")


def malformed_ops_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, value, error) of the texts that hold no JSON array of records."""
    return _ops_texts(spark, path, lines).where("r is null").select("file", "value", F.lit("no JSON array of records").alias("error"))


def split_ops_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of files that hold JSON arrays of op records, of any size.

    Files are read in pieces up to each closing brace, by all tasks that their blocks give. Sums that run through the blocks tell which braces stand in
    strings and which one ends a record, by parts of PIECES pieces, so no sum holds a whole block. records: file, seq (the place in the file) and the
    record's fields. quarantine: file, seq, value, error, for records that don't parse and for what stands between records; the
    records around them are kept. A record whose braces don't match takes what follows up to their match with it.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    keys, order, part = ["file"], ["block", "row"], F.struct("block", F.floor(F.col("row") / PIECES).alias("at"))
    rows = cut(running_sum(pieces.withColumn("_q", quotes), {"_quotes": F.col("_q")}, keys, order, part=part))
    inside = (F.col("_quotes") - F.col("_q")) % 2 == 1
    bare = F.regexp_replace(F.when(inside, F.regexp_replace(plain, '^[^"]*"?', "")).otherwise(plain), '"[^"]*("|$)', "")
    opens = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
    # What follows the last record of a file has no brace of its own.
    blank = F.col("value").rlike(r"^[\s,\[\]]*$") & ~inside
    rows = rows.withColumn("_close", (F.col("_quotes") % 2 == 0).cast("long")).withColumn("_step", opens - F.col("_close"))
    rows = cut(running_sum(rows, {"_depth": F.col("_step")}, keys, order, part=part))
    rows = rows.withColumn("_end", ((F.col("_depth") <= 0) & (F.col("_close") == 1)).cast("long"))
    rows = running_sum(rows, {"_ends": F.col("_end")}, keys, order, part=part).where(~blank | (F.col("_depth") >= 0))
    piece = F.struct("block", "row", F.concat("value", F.lit("}")).alias("v"))
    texts = rows.groupBy("file", (F.col("_ends") - F.col("_end")).alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["v"]), "").alias("text"))
    stray = F.regexp_extract("text", r"^([^{]*)", 1)
    texts = texts.select("file", "seq", F.regexp_replace(stray, r"^[\s,\[\]]+|[\s,\[\]]+$", "").alias("stray"), F.expr("substring(text, length(regexp_extract(text, '^([^{]*)', 1)) + 1)").alias("value"))
    parsed = cut(texts.withColumn("r", F.from_json("value", OPS_SCHEMA[:-1] + ",_corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"})))
    bad = (F.col("value") != "") & (F.col("r").isNull() | F.col("r._corrupt").isNotNull())
    records = parsed.where((F.col("value") != "") & ~bad).select("file", "seq", "r.*").drop("_corrupt")
    faults = parsed.where(bad).select("file", "seq", "value", F.lit("no op record").alias("error"))
    return records, faults.union(parsed.where(F.col("stray") != "").select("file", "seq", F.col("stray").alias("value"), F.lit("text between records").alias("error")))


#: Entities that every XML text may use. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
#: What holds no elements: comments and character data.
SKIPPED = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
QUOTED = r"(?:\"[^\"]*\"|'[^']*')"


def unescaped(s: Column) -> Column:
    """An attribute's text without entities, numeric ones included; each is resolved once, so what comes out of one begins none."""
    entity = rf"&#(?:[0-9]+|x[0-9A-Fa-f]+);|{'|'.join(ENTITIES)}"
    code = lambda e: F.when(e.startswith("&#x"), F.lpad(F.regexp_extract(e, "x([0-9A-Fa-f]+)", 1), 8, "0")).otherwise(F.lpad(F.hex(F.regexp_extract(e, "([0-9]+)", 1).cast("long")), 8, "0"))
    named = lambda e: reduce(lambda c, kv: c.when(e == kv[0], kv[1]), ENTITIES.items(), F.when(F.lit(False), ""))
    char = lambda e: F.when(e.startswith("&#"), F.decode(F.unhex(code(e)), "UTF-32")).otherwise(named(e))
    parts = F.zip_with(F.split(s, entity, -1), F.regexp_extract_all(s, F.lit(entity), F.lit(0)), lambda gap, e: F.concat(gap, F.coalesce(char(e), F.lit(""))))
    return F.when(F.contains(s, F.lit("&")), F.array_join(parts, "")).otherwise(s)


def attributes(element: Column) -> Column:
    """The attributes of an element's tag, names and quoted values."""
    return F.regexp_extract_all(element, F.lit(rf"[\w:.-]+\s*=\s*{QUOTED}"), F.lit(0))


def attribute(attrs: Column, name: str) -> Column:
    """The value of one of attributes, without entities; null if it isn't there or empty."""
    own = F.get(F.filter(attrs, lambda a: a.rlike(rf"^{name}\s*=")), F.lit(0))
    value = F.transform(F.array(F.regexp_extract(own, r"(?s)=\s*.(.*).$", 1)), unescaped)
    return F.get(F.filter(value, lambda v: v != ""), F.lit(0))


def read_elements(pages: DataFrame) -> DataFrame:
    """pages (file, page, xml) -> what opens, closes and draws, in the order of the markup: file, page, seq, tag, scope, matrix and the drawn element's attributes.

    A Canvas that opens is a save, its end a restore, as inherit_matrix reads them; matrix is its RenderTransform, an attribute or a property element with a
    MatrixTransform in it, null if it has none or it is no six numbers. An empty Canvas opens nothing. Paths carry data, fill and stroke, Glyphs
    unicode_string, fill and their origin (0 where absent). Comments and CDATA are skipped; null markup has no elements.
    """
    xml = F.regexp_replace("xml", SKIPPED, "")
    tags = F.regexp_extract_all(xml, F.lit(rf"</?(?:[\w-]+:)?(?:Canvas\.RenderTransform|MatrixTransform|Canvas|Path|Glyphs)(?=[\s/>])(?:[^>\"']|{QUOTED})*>"), F.lit(0))
    local = lambda e: F.regexp_extract(e, r"^</?(?:[\w-]+:)?([\w.]+)", 1)
    # Each tag with the two after it, where a property element would be.
    near = lambda t: F.transform(t, lambda e, i: F.struct(e.alias("e"), F.get(t, i + 1).alias("one"), F.get(t, i + 2).alias("two")))
    found = pages.select("file", "page", tags.alias("t")).select("file", "page", F.posexplode(near(F.col("t"))).alias("seq", "x")).select("file", "page", "seq", "x.*")
    found = found.withColumns({"a": attributes(F.col("e")), "m": F.when((local(F.col("one")) == "Canvas.RenderTransform") & (local(F.col("two")) == "MatrixTransform"), attributes(F.col("two")))})
    shut, empty = F.col("e").startswith("</"), F.col("e").endswith("/>")
    matrix = F.transform(F.array(F.coalesce(attribute(F.col("a"), "RenderTransform"), attribute(F.col("m"), "Matrix"))), parse_matrix)
    rows = found.withColumn("tag", local(F.col("e"))).where(F.col("tag").isin("Canvas", "Path", "Glyphs") & ~((F.col("tag") == "Canvas") & empty) & ~((F.col("tag") != "Canvas") & shut))
    drawn = lambda name, *of: F.when(F.col("tag").isin(*of), attribute(F.col("a"), name))
    number = lambda name: F.when(F.col("tag") == "Glyphs", F.coalesce(attribute(F.col("a"), name).try_cast("double"), F.lit(0.0)))
    return rows.select(
        "file", "page", F.col("seq").cast("long").alias("seq"), "tag",
        F.when(F.col("tag") == "Canvas", F.when(shut, "restore").otherwise("save")).alias("scope"),
        F.when((F.col("tag") == "Canvas") & ~shut, F.get(matrix, F.lit(0))).alias("matrix"),
        drawn("Data", "Path").alias("data"), drawn("Fill", "Path", "Glyphs").alias("fill"), drawn("Stroke", "Path").alias("stroke"),
        drawn("UnicodeString", "Glyphs").alias("unicode_string"), number("OriginX").alias("origin_x"), number("OriginY").alias("origin_y"),
    )


def read_markup(pages: DataFrame) -> dict[str, DataFrame]:
    """pages (file, page, xml) -> pages, paths and glyphs, with the defaults of absent attributes; glyphs without text are left out.

    Elements are found by local name, whatever their prefix, by patterns that know quotes of both kinds, so that a value may hold
    a bracket; comments and CDATA are skipped and entities of values resolved. It is no validating parser: DTDs are not read. read_elements keeps order and nesting.
    """
    xml = F.regexp_replace("xml", SKIPPED, "")

    def elements(tag: str) -> Column:
        return F.regexp_extract_all(xml, F.lit(rf"<(?:[\w.-]+:)?{tag}(?=[\s/>])((?:[^>\"']|{QUOTED})*)>"), F.lit(1))

    def rows(tag: str, names: dict[str, str]) -> DataFrame:
        found = pages.select("file", "page", F.posexplode(elements(tag)).alias("ord", "e")).withColumn("a", attributes(F.col("e")))
        return found.select("file", "page", "ord", *[attribute(F.col("a"), a).alias(k) for k, a in names.items()])

    size = lambda name, d: F.coalesce(attribute(attributes(F.get(elements("FixedPage"), F.lit(0))), name).try_cast("double"), F.lit(d))
    paths = rows("Path", {"data": "Data", "fill": "Fill", "stroke": "Stroke", "stroke_thickness": "StrokeThickness", "opacity": "Opacity", "name": "Name"})
    glyphs = rows("Glyphs", {"unicode_string": "UnicodeString", "origin_x": "OriginX", "origin_y": "OriginY", "fill": "Fill", "font_size": "FontRenderingEmSize", "font_uri": "FontUri"})
    return {
        "pages": pages.select("file", "page", size("Width", PAGE_WIDTH).alias("width"), size("Height", PAGE_HEIGHT).alias("height")),
        "paths": paths.withColumns({"stroke_thickness": F.coalesce("stroke_thickness", F.lit("1")), "opacity": F.coalesce("opacity", F.lit("1"))}),
        "glyphs": glyphs.where("unicode_string is not null"),
    }


def read_html(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, html) -> (links, headings), in the order of the markup."""
    def found(pattern: str, name: str) -> DataFrame:
        return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("ord", name))

    return found(r'<a href="([^"]*)"', "href"), found(r"<h1>([^<]*)</h1>", "heading")


#: A character that no XML text may hold, whatever its version.
BETWEEN = "\uffff"


def read_descriptor(files: DataFrame) -> dict[str, DataFrame]:
    """files (file, xml) -> page (name, plot order), its first paper, and all name and value properties, repeated names included.

    An XML text is parsed anew by each path that is sought in it, which is what a descriptor costs. So all single values come from one path, and what
    was found is kept: three parses a file, however many of the tables are used. Files are dealt to all tasks first, since a table of short texts has few splits.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [f"string((//*[local-name()='{tag}'])[1]/@{a})" for tag, a in (("Page", "name"), ("Page", "plotOrder"), *[("Paper", a) for a in ("width", "height", "units", "color")])]
    all_ = lambda a: F.xpath("xml", F.lit(f"//*[local-name()='Property']/@{a}"))
    single = F.split(F.xpath_string("xml", F.lit("concat(" + f", '{BETWEEN}', ".join(at) + ")")), BETWEEN, -1)
    found = cut(files.repartition(n, "file").select("file", single.alias("single"), F.arrays_zip(all_("name").alias("name"), all_("value").alias("value")).alias("p")))
    one = lambda i: F.nullif(F.get("single", F.lit(i)), F.lit(""))
    return {
        "page": found.select("file", one(0).alias("name"), one(1).try_cast("double").alias("plot_order")),
        "paper": found.select("file", *[one(i).alias(f"paper_{a}") for i, a in enumerate(("width", "height", "units", "color"), 2)]),
        "properties": found.select("file", F.posexplode("p").alias("ord", "p")).select("file", "ord", "p.name", "p.value"),
    }


def write_ledger(steps: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64, files: int = 16) -> None:
    """The steps of every run, failed ones too. A run's rows lie in one folder, bucket=its hash modulo buckets, in one of as many as files files."""
    dealt = steps.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)))
    dealt.repartition("bucket", F.pmod(F.xxhash64("run", F.lit(1)), F.lit(files))).sortWithinPartitions("bucket", "run").write.mode("overwrite").partitionBy("bucket").format(fmt).save(path)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """A report as JSON or CSV files."""
    writer = report.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
