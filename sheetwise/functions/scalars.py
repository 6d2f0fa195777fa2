"""Scalar functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
#: Points in each unit. Fixed values.
UNITS = {"point": 1.0, "inch": 72.0, "mm": 72 / 25.4, "px96": 0.75}
EPOCH_1601 = 11_644_473_600  # seconds from 1601 to 1970
LAYOUT = {"i16": (2, True), "u16": (2, False), "i32": (4, True), "u32": (4, False), "u8": (1, False)}
#: Tried in this order. Fixed values.
TIME_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "MM/dd/yyyy HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd", "MM/dd/yyyy"]
#: Flag bits. Fixed values.
MEANING = {0x1: "NONE", 0x2: "SEAL", 0x4: "STAMP", 0x8: "LABEL", 0x10: "REDLINE", 0x20: "RESERVED1", 0x40: "RESERVED2"}
ORIENTATION = {0x1: "ALWAYS_IN_SYNC", 0x2: "ALWAYS_DIFFERENT", 0x4: "DECOUPLED"}
ALIGNMENT = {
    0x1: "ALIGN_CENTER", 0x2: "ALIGN_TITLE_BLOCK", 0x4: "ALIGN_TOP", 0x8: "ALIGN_BOTTOM", 0x10: "ALIGN_LEFT", 0x20: "ALIGN_RIGHT",
    0x40: "ALIGN_TOP_LEFT", 0x80: "ALIGN_TOP_RIGHT", 0x100: "ALIGN_BOTTOM_LEFT", 0x200: "ALIGN_BOTTOM_RIGHT", 0x400: "ALIGN_NONE",
}


def _some(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def place(x: Column, y: Column, scale, flip_y: bool = False, height=None) -> tuple[Column, Column]:
    """Scaled coordinates; with flip_y, measured from the top of a page of that height."""
    return x * _some(scale), (_some(height) - y * _some(scale)) if flip_y else y * _some(scale)


def fit_scale(w: Column, h: Column, pw, ph, margin=36) -> Column:
    """The largest scale at which w by h fits into the page within its margins; null if both are 0."""
    return F.least(F.try_divide(_some(pw) - 2 * _some(margin), w), F.try_divide(_some(ph) - 2 * _some(margin), h))


def page_size(kind: Column, w: Column, h: Column, scale, cap: float | None = None) -> tuple[Column, Column]:
    """Named size, or box times scale plus 72; letter without a box; at most cap."""
    sizes = {"letter": (612.0, 792.0), "a4": (595.0, 842.0), "a3": (842.0, 1191.0), "tabloid": (792.0, 1224.0)}
    out = []
    for i, side in enumerate((w, h)):
        auto = F.coalesce(side * _some(scale) + 72, F.lit(sizes["letter"][i]))
        c = auto
        for name, s in sizes.items():
            c = F.when(F.lower(kind) == name, F.lit(s[i])).otherwise(c)
        out.append(F.least(c, F.lit(cap)) if cap else c)
    return tuple(out)


def convert_units(v: Column, source: str, target: str) -> Column:
    """A length in another unit."""
    return v * (UNITS[source] / UNITS[target])


def aspect(w: Column, h: Column) -> Column:
    return F.coalesce(F.try_divide(w, h), F.lit(0.0))


def aspect_match(a: Column, b: Column) -> Column:
    """match under 1 % difference, close under 5 %, else mismatch."""
    p = F.coalesce(F.try_divide(100 * F.abs(a - b), b), F.lit(0.0))
    return F.when(p < 1, "match").when(p < 5, "close").otherwise("mismatch")


def size_bucket(kb: Column) -> Column:
    return F.when(kb < 5, "likely empty/invisible").when(kb < 50, "minimal content").when(kb < 200, "some content").otherwise("significant content")


def within(actual: Column, expected: Column, tol: float = 0.001) -> Column:
    return F.abs(actual - expected) < tol


def affine(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """x and y under six matrix numbers; unchanged without a matrix."""
    g = lambda i: F.get(m, F.lit(i))
    return F.coalesce(g(0) * x + g(2) * y + g(4), x), F.coalesce(g(1) * x + g(3) * y + g(5), y)


def parse_matrix(s: Column) -> Column:
    """Six comma-separated numbers, else null."""
    parts = F.transform(F.split(s, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == 6) & F.forall(parts, lambda p: p.isNotNull()), parts)


def transform_path(s: Column, m: Column) -> Column:
    """A path text with M and L pairs and H and V values mapped, to two decimals; other commands as they are."""
    tokens = F.regexp_extract_all(s, F.lit(r"[A-Za-z][^A-Za-z]*"), F.lit(0))

    def one(t: Column) -> Column:
        n = F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
        c = F.substring(t, 1, 1)
        x, y = affine(F.get(n, F.lit(0)), F.get(n, F.lit(1)), m)
        hx, _ = affine(F.get(n, F.lit(0)), F.lit(0.0), m)
        _, vy = affine(F.lit(0.0), F.get(n, F.lit(0)), m)
        return F.when(c.isin("M", "L") & (F.size(n) >= 2), F.format_string("%s%.2f,%.2f", c, x, y)).when((c == "H") & (F.size(n) >= 1), F.format_string("H%.2f", hx)).when((c == "V") & (F.size(n) >= 1), F.format_string("V%.2f", vy)).otherwise(F.trim(t))

    return F.array_join(F.transform(tokens, one), " ")


def _hex(s: Column) -> Column:
    return F.conv(s, 16, 10).cast("int")


def parse_colour(s: Column) -> Column:
    """(r, g, b, a) of #AARRGGBB or #RRGGBB; null for empty and transparent; black for anything else."""
    c = F.lower(F.trim(s))
    part = lambda i: _hex(F.substring(c, i, 2))
    colour = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))
    black = colour(F.lit(0), F.lit(0), F.lit(0), F.lit(255))
    return (
        F.when((F.coalesce(c, F.lit("")) == "") | (c == "transparent"), None)
        .when(c.rlike("^#[0-9a-f]{8}$"), colour(part(4), part(6), part(8), part(2)))
        .when(c.rlike("^#[0-9a-f]{6}$"), colour(part(2), part(4), part(6), F.lit(255))).otherwise(black)
    )


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)]))


def bgra_to_rgb(packed: Column) -> Column:
    """r, g, b of a 32-bit BGRA number, blue in the highest byte."""
    byte = lambda k: F.shiftright(packed, k).bitwiseAND(255)
    return F.struct(byte(8).alias("r"), byte(16).alias("g"), byte(24).alias("b"))


def unpack_colour(packed: Column) -> Column:
    """r, g, b, a of a 32-bit number, red in the lowest byte."""
    byte = lambda k: F.shiftright(packed, k).bitwiseAND(255)
    return F.struct(*[byte(k).alias(n) for n, k in (("r", 0), ("g", 8), ("b", 16), ("a", 24))])


def to_byte(unit: Column) -> Column:
    """0 to 1 as 0 to 255, truncated."""
    return (unit * 255).cast("int")


def unpack_dims(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND(0xFFFF), F.shiftrightunsigned(packed, 16).bitwiseAND(0xFFFF)


def pack_dims(w: Column, h: Column) -> Column:
    return w.bitwiseAND(0xFFFF).bitwiseOR(F.shiftleft(h.bitwiseAND(0xFFFF), 16))


def shape_kind(w: Column, h: Column) -> Column:
    return F.when((h == 0) | (w == h), "circle").otherwise("ellipse")


def to_degrees(units: Column) -> Column:
    """1/65536ths of a turn in degrees."""
    return units * 360.0 / 65536


def norm_degrees(d: Column) -> Column:
    return F.pmod(d, F.lit(360))


def is_full_circle(start: Column, end: Column) -> Column:
    return F.pmod(end - start, F.lit(65536)) == 0


def unwrap32(v: Column) -> Column:
    return F.when(v > 2_000_000_000, v - 2**32).otherwise(v)


def from_unix(s: Column) -> Column:
    return F.timestamp_seconds(s)


def parse_ts(s: Column) -> Column:
    """The first of six patterns that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in TIME_PATTERNS])


def from_filetime(low: Column, high: Column) -> Column:
    """A timestamp from two 32-bit halves of 100 ns since 1601."""
    ticks = F.shiftleft(high.cast("long"), 32) + low.cast("long")
    return F.timestamp_micros((ticks / 10).cast("long") - EPOCH_1601 * 1_000_000)


def to_filetime(t: Column) -> Column:
    return (F.unix_micros(t) + EPOCH_1601 * 1_000_000) * 10


def format_guid(hex32: Column) -> Column:
    """8-4-4-4-12 groups of 32 hex digits, lower case, in braces."""
    return F.concat(F.lit("{"), F.regexp_replace(F.lower(hex32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit("}"))


def parse_guid(s: Column) -> Column:
    """32 lower-case hex digits of a GUID text, with or without braces; null if it is none."""
    ok = s.rlike(r"^\{?[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?$")
    return F.when(ok, F.lower(F.regexp_replace(s, "[{}-]", "")))


def decode_int(data: Column, at: int, kind: str) -> Column:
    """A little-endian integer of BINARY data at a byte, or null past its end."""
    n, signed = LAYOUT[kind]
    digits = F.concat(*[F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(n))])
    v = F.when(F.length(data) >= at + n, F.conv(digits, 16, 10).cast("long"))
    return F.when(v >= 2 ** (8 * n - 1), v - 2 ** (8 * n)).otherwise(v) if signed else v


def decode_fixed(data: Column, layout: list[tuple[str, str]]) -> Column:
    """A struct of the layout's (field, kind) in order; null unless the length matches."""
    fields, at = [], 0
    for name, kind in layout:
        fields.append(decode_int(data, at, kind).alias(name))
        at += LAYOUT[kind][0]
    return F.when(F.length(data) == at, F.struct(*fields))


def decode_count(data: Column, encoding: str) -> Column:
    """A count: zero_u16 (0 means 256 + u16), ff_u16 (255 means u16) or ff_i32 (255 means i32)."""
    first = decode_int(data, 0, "u8")
    if encoding == "zero_u16":
        return F.when(first == 0, 256 + decode_int(data, 1, "u16")).otherwise(first)
    return F.when(first == 255, decode_int(data, 1, {"ff_u16": "u16", "ff_i32": "i32"}[encoding])).otherwise(first)


#: Op codes of records that are a count and so many points, with the encodings of both. Fixed values.
POINT_RECORDS = {0x10: ("zero_u16", "i16"), 0x14: ("zero_u16", "i16"), 0x70: ("ff_u16", "i32"), 0x74: ("zero_u16", "i32")}


def decode_points(data: Column, encoding: str, kind: str = "i16") -> Column:
    """A record of a count and so many points: count, points (x, y) and error.

    The count takes 1 byte or, extended, 3 or 5, as decode_count has it. points is null and error tells why if the bytes have no whole count, the count is negative or
    the length differs from what the count asks for.
    """
    n = LAYOUT[kind][0]
    long = {"zero_u16": 3, "ff_u16": 3, "ff_i32": 5}[encoding]
    start = F.when(decode_int(data, 0, "u8") == (0 if encoding == "zero_u16" else 255), long).otherwise(1)
    none = F.array().cast("array<struct<x:bigint,y:bigint>>")

    def record(r: Column) -> Column:
        # Places are counted once a record, not once a point.
        count, start, found = r["count"], r["start"], r["found"]
        point = lambda i: F.struct(*[decode_int(data, (start + (2 * i + k) * n).cast("int"), kind).alias(c) for k, c in enumerate("xy")])
        need = start + count * 2 * n
        error = F.when(count.isNull(), "no whole count").when(count < 0, "negative count").when(found != need, F.format_string("expected %d bytes, found %d", need.cast("long"), found))
        points = F.when(count == 0, none).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), point))
        return F.struct(count.alias("count"), F.when((count >= 0) & (found == need), points).alias("points"), error.alias("error"))

    head = F.struct(decode_count(data, encoding).alias("count"), start.alias("start"), F.length(data).cast("long").alias("found"))
    return F.get(F.transform(F.array(head), record), F.lit(0))


_PAIR = r"\(\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\)"
#: What is sought in the text of each uncounted shape, and what a counted one needs. Fixed values.
_SOUGHT = {"line": (_PAIR + r"\s*" + _PAIR, 4), "circle": (_PAIR + r"\s+(-?[0-9]+)", 3), "ellipse": (_PAIR + r"\s+(-?[0-9]+)\s*,\s*(-?[0-9]+)", 4)}
_LEAST = {"polyline": 1, "polytriangle": 3}
_EXPECTED = {"line": "'(x1,y1)(x2,y2)'", "circle": "'(x,y) radius'", "ellipse": "'(x,y) major,minor'", "polyline": "vertex count", "polytriangle": "vertex count"}


def parse_ascii_geom(kind: str, s: Column) -> Column:
    """(values, error) of a textual line, circle, ellipse, polyline or polytriangle.

    A line is two points in brackets, a circle a point and a radius, an ellipse a point and two axes: the first such place of the text
    counts. The other two begin with a count, followed by as many points as it says. values are x, y, x, y, ..., then radius or axes;
    error is null if there are values. Numbers beyond 64 bits are an error.
    """
    trimmed = F.regexp_replace(s, r"^\s+|\s+$", "")
    invalid = F.concat(F.lit(f"Invalid ASCII {kind} format: expected {_EXPECTED[kind]}, got: "), trimmed)
    if kind in _SOUGHT:
        pattern, n = _SOUGHT[kind]
        nums = F.array(*[F.regexp_extract(s, pattern, k + 1).try_cast("long") for k in range(n)])
        error = F.when(~s.rlike(pattern), invalid)
        if kind == "circle":
            error = error.when(nums[2] < 0, F.concat(F.lit("Invalid radius: "), nums[2].cast("string"), F.lit(". Radius must be non-negative.")))
        if kind == "ellipse":
            error = error.when((nums[2] < 0) | (nums[3] < 0), F.concat(F.lit("Invalid axes: major="), nums[2].cast("string"), F.lit(", minor="), nums[3].cast("string"), F.lit(". Axes must be non-negative.")))
    else:
        count = F.regexp_extract(s, r"^\s*([0-9]+)", 1)
        axis = lambda k: F.regexp_extract_all(s, F.lit(_PAIR), F.lit(k))
        points = F.zip_with(axis(1), axis(2), lambda x, y: F.array(x.try_cast("long"), y.try_cast("long")))
        nums, least = F.flatten(points), _LEAST[kind]
        few = "Must be at least 1." if least == 1 else f"Polytriangle requires at least {least} vertices."
        error = (
            F.when(count == "", invalid)
            .when(count.try_cast("long") < least, F.concat(F.lit("Invalid vertex count: "), count.try_cast("long").cast("string"), F.lit(f". {few}")))
            .when(F.coalesce(count.try_cast("long") != F.size(points), F.lit(True)), F.concat(F.lit("Vertex count mismatch: expected "), count, F.lit(" vertices, found "), F.size(points).cast("string")))
        )
    error = F.when(s.isNull(), "no text").otherwise(error.when(F.exists(nums, lambda x: x.isNull()), "number out of range"))
    return F.struct(F.when(error.isNull(), nums).alias("values"), error.alias("error"))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def parse_meta(name: str, s: Column) -> Column:
    """The fields of a metadata text, null where it is malformed.

    PlotInfo: show or hide, rotation, unit mm or in, paper, printable area, six numbers. Units: a quoted name and six numbers. InkedArea: just
    four points in brackets. View: two points, or a quoted name. NamedView: two points and a name. Others: a value, quoted or not.
    Texts, tokens and matches are each computed once; who takes several fields should keep the struct in a column of its own first.
    """
    body = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\)+$", "") if name != "InkedArea" else s
    numbers = lambda ts: F.transform(ts, lambda x: x.try_cast("double"))
    whole = lambda ns, n: (F.size(ns) == n) & F.forall(ns, lambda x: x.isNotNull())
    if name == "PlotInfo":

        def plot(p: Column) -> Column:
            flag, unit, ns = p["flag"], p["unit"], p["ns"]
            num = lambda i: F.get(ns, F.lit(i))
            fine = flag.isin("show", "hide") & unit.isin("mm", "in") & whole(ns, 13)
            return F.when(fine, F.struct(
                (flag == "show").alias("show"), num(0).alias("rotation"), unit.alias("unit"), num(1).alias("width"), num(2).alias("height"),
                F.slice(ns, 4, 4).alias("area"), F.slice(ns, 8, 6).alias("matrix"),
            ))

        parts = lambda ts: F.struct(F.lower(F.get(ts, F.lit(0))).alias("flag"), F.lower(F.get(ts, F.lit(2))).alias("unit"), numbers(F.concat(F.slice(ts, 2, 1), F.slice(ts, 4, 12))).alias("ns"))
        return bound(bound(F.split(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\s+"), parts), plot)
    if name == "Units":
        parts = lambda b: F.struct(b.alias("b"), numbers(F.split(F.regexp_extract(b, r'^"[^"]*"\s*(.*?)\s*$', 1), r"\s+")).alias("ns"))
        return bound(bound(body, parts), lambda p: F.when(p["b"].rlike(r'^"[^"]*"') & whole(p["ns"], 6), F.struct(F.regexp_extract(p["b"], r'^"([^"]*)"', 1).alias("name"), p["ns"].alias("matrix"))))
    if name == "InkedArea":
        xy = F.struct(*[F.regexp_extract_all(s, F.lit(_PAIR), F.lit(k)).alias(c) for k, c in ((1, "x"), (2, "y"))])
        return bound(xy, lambda p: F.when(F.size(p["x"]) == 4, F.zip_with(p["x"], p["y"], lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))))
    if name in ("View", "NamedView"):
        point = r"(-?[0-9]+)\s*,\s*(-?[0-9]+)"
        named = r"(?:'([^']*)'|\"([^\"]*)\"|(\S+))"
        pattern = rf"^\s*{point}\s+{point}" + (rf"\s+{named}" if name == "NamedView" else "") + r"\s*$"
        quoted = r"^\s*(?:'([^']*)'|\"([^\"]*)\")\s*$"

        def box(b: Column) -> Column:
            return F.when(b.rlike(pattern), F.array(*[F.regexp_extract(b, pattern, k).try_cast("long") for k in range(1, 5)]))

        def own(b: Column) -> Column:
            if name == "NamedView":
                return F.concat(*[F.regexp_extract(b, pattern, k) for k in (5, 6, 7)])
            return F.when(b.rlike(quoted), F.concat(F.regexp_extract(b, quoted, 1), F.regexp_extract(b, quoted, 2)))

        some = lambda v: v["box"].isNotNull() if name == "NamedView" else v["box"].isNotNull() | v["name"].isNotNull()
        return bound(bound(body, lambda b: F.struct(box(b).alias("box"), own(b).alias("name"))), lambda v: F.when(some(v), v))
    quoted = r"^(?:\"([^\"]*)\"|'([^']*)').*$"
    return bound(body, lambda b: F.nullif(F.when(b.rlike(quoted), F.concat(F.regexp_extract(b, quoted, 1), F.regexp_extract(b, quoted, 2))).otherwise(F.trim(b)), F.lit("")))


def number_pairs(s: Column, scale: float = 1.0) -> Column:
    """All numbers of a text in pairs (x, y), scaled; an odd last one is dropped."""
    nums = F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double") * scale)
    half = F.floor(F.size(nums) / 2).cast("int")
    return F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.struct(F.get(nums, 2 * i).alias("x"), F.get(nums, 2 * i + 1).alias("y")))).otherwise(F.lit([]).cast("array<struct<x:double,y:double>>"))


def norm_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.least(x1, x2).alias("min_x"), F.least(y1, y2).alias("min_y"), F.greatest(x1, x2).alias("max_x"), F.greatest(y1, y2).alias("max_y"))


def text_box(x: Column, y: Column, s: Column, size: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), (F.length(s) * size * 0.6).alias("width"), size.cast("double").alias("height"))


def decode_text(b: Column) -> Column:
    """UTF-16LE bytes if they are of even length and hold a zero in the second byte, else UTF-8, lossy."""
    wide = (F.length(b) % 2 == 0) & (F.hex(F.substring(b, 2, 1)) == "00")
    return F.when(wide, F.decode(b, "UTF-16LE")).otherwise(F.make_valid_utf8(b.cast("string")))


def escape_text(s: Column) -> Column:
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))


def decode_flags(mask: Column, names: dict[int, str]) -> Column:
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(bit) != 0, F.lit(n)) for bit, n in names.items()]))


def split_version(v: Column) -> tuple[Column, Column]:
    return F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.([^.]*)$", 1))


def arc_points(cx: Column, cy: Column, r: Column, a0: Column, a1: Column) -> Column:
    """Points of an arc in degrees: max(10, span / 10) steps, evenly spaced."""
    steps = F.greatest(F.lit(10), (F.abs(a1 - a0) / 10).cast("int"))
    at = lambda i: (a0 + (a1 - a0) * i / steps) * (math.pi / 180)
    return F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct((cx + r * F.cos(at(i))).alias("x"), (cy + r * F.sin(at(i))).alias("y")))


def line_width(w: Column) -> Column:
    return F.greatest(F.lit(0.1), w * 0.01)


def dash(name: Column) -> Column:
    return F.when(name == "dashed", F.array(F.lit(3), F.lit(3))).when(name == "dotted", F.array(F.lit(1), F.lit(2)))
