"""Boxes, fits and figures over points (drawing_id, shape_id, pt, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import affine, transform_path
from .kept import cut
from .state import CHUNK, framed, inherit_matrix

#: Standard pages, width and height in points. Fixed values.
PAGES = [
    ("Letter", 612, 792), ("Legal", 612, 1008), ("Tabloid", 792, 1224), ("A4", 595, 842), ("A3", 842, 1191), ("A2", 1191, 1684), ("A1", 1684, 2384),
    ("A0", 2384, 3370), ("ARCH A", 648, 864), ("ARCH B", 864, 1296), ("ARCH C", 1296, 1728), ("ARCH D", 1728, 2592), ("ARCH E", 2592, 3456),
]
NEAR_PAGE = 50


def bbox(points: DataFrame, mode: str = "all") -> DataFrame:
    """Box, size, aspect (0 if flat), point and shape counts of each drawing.

    Points may carry role (vertex, start, end, center, position) and radius or extent w, h. mode: all takes every role and
    widens centres by radius and positions by extent; vertices takes vertex, start and end; anchors adds center and position
    unwidened; repaired undoes 32-bit wrap-around first; relative is all for points that move a pen (seq, kind, as to_absolute takes them).
    """
    has = set(points.columns)
    if mode == "relative":
        return _with_sizes(_relative_box(points))
    x, y = F.col("x"), F.col("y")
    if mode == "repaired":
        x, y = (F.when(c > 2_000_000_000, c - 2**32).otherwise(c) for c in (x, y))
    if "role" in has and mode == "vertices":
        points = points.where(F.col("role").isin("vertex", "start", "end"))
    wide = mode in ("all", "repaired")
    r = F.coalesce("radius", F.lit(0)) if wide and "radius" in has else F.lit(0)
    w, h = (F.coalesce(c, F.lit(0)) if wide and c in has else F.lit(0) for c in ("w", "h"))
    box = points.groupBy("drawing_id").agg(
        F.min(x - r).alias("min_x"), F.max(x + r + w).alias("max_x"), F.min(y - r).alias("min_y"), F.max(y + r + h).alias("max_y"),
        F.count("*").alias("points"), F.count_distinct("shape_id").alias("shapes"),
    )
    return _with_sizes(box)


def _with_sizes(box: DataFrame) -> DataFrame:
    width, height = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return box.select("*", width.alias("width"), height.alias("height"), F.coalesce(F.try_divide(width, height), F.lit(0.0)).alias("aspect"))


def _relative_box(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Boxes of points (drawing_id, shape_id, seq, pt, kind, x, y) whose places follow from a pen, by parts of a drawing.

    A part gives its box up to its first origin from where the pen came in, its box after that, and where the pen goes; those compose, so no drawing
    is sorted whole and no point is made absolute. Points may carry radius and w, h.
    """
    has = set(points.columns)
    order = ["seq", "pt"]
    extra = {k: F.coalesce(k, F.lit(0)) if k in has else F.lit(0) for k in ("radius", "w", "h")}
    rows = points.withColumn("_g", F.struct("drawing_id", F.floor(F.col("seq") / chunk).alias("_c")))
    w = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_e", F.count_if(F.col("kind") == "origin").over(w))
    run = W.partitionBy("_g", "_e").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    moves = F.col("kind").isin("origin", "rel")
    rows = rows.withColumns({f"_p{c}": F.sum(F.when(moves, F.col(c)).otherwise(0)).over(run) for c in "xy"})
    at = {c: F.when(F.col("kind") == "abs", F.col(c)).when(moves, F.col(f"_p{c}")).otherwise(F.col(f"_p{c}") + F.col(c)) for c in "xy"}
    floats = (F.col("_e") == 0) & (F.col("kind") != "abs")
    sides = {"min_x": (F.min, at["x"] - extra["radius"]), "max_x": (F.max, at["x"] + extra["radius"] + extra["w"]), "min_y": (F.min, at["y"] - extra["radius"]), "max_y": (F.max, at["y"] + extra["radius"] + extra["h"])}
    parts = rows.groupBy("_g").agg(
        F.max("_e").alias("_n"), *[F.max_by(f"_p{c}", F.struct("_e", *order)).alias(f"_s{c}") for c in "xy"], F.count("*").alias("points"),
        *[f(F.when(floats, v)).alias(f"_f{k}") for k, (f, v) in sides.items()], *[f(F.when(~floats, v)).alias(f"_a{k}") for k, (f, v) in sides.items()],
    )
    upto = lambda *more: W.partitionBy("_g.drawing_id", *more).orderBy("_g._c").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("_run", F.sum((F.col("_n") > 0).cast("int")).over(upto())).withColumns({f"_t{c}": F.sum(f"_s{c}").over(upto("_run")) for c in "xy"})
    came = W.partitionBy("_g.drawing_id").orderBy("_g._c")
    parts = parts.withColumns({f"_i{c}": F.coalesce(F.lag(f"_t{c}").over(came), F.lit(0)) for c in "xy"})
    box = parts.groupBy(F.col("_g.drawing_id").alias("drawing_id")).agg(
        *[f((F.least if f is F.min else F.greatest)(F.col(f"_f{k}") + F.col(f"_i{k[-1]}"), F.col(f"_a{k}"))).alias(k) for k, (f, _) in sides.items()], F.sum("points").alias("points")
    )
    shapes = points.groupBy(F.col("drawing_id").alias("_d")).agg(F.count_distinct("shape_id").alias("shapes"))
    return box.join(shapes, box["drawing_id"].eqNullSafe(shapes["_d"])).drop("_d")


def element_scopes(elements: DataFrame) -> DataFrame:
    """The canvases that elements lie in, for placed_elements."""
    return framed(elements.select(F.struct("file", "page").alias("drawing_id"), "seq", "scope", "matrix"))


def placed_elements(elements: DataFrame, compose: bool = False, scopes: DataFrame | None = None) -> DataFrame:
    """Elements of pages, as read_elements gives them -> the drawn ones with depth, matrix in force, and data and origins under it.

    The matrix is the nearest open canvas's that has one or, with compose, the product of all. Paths and origins under no matrix stay as they are.
    Who wants both gives elements that are kept and their element_scopes, so that neither is computed twice.
    """
    marked = elements.withColumn("drawing_id", F.struct("file", "page"))
    marked = cut(marked) if scopes is None else marked
    force = inherit_matrix(marked.select("drawing_id", "seq", "scope", "matrix") if scopes is None else scopes, compose)
    force = force.select(F.col("drawing_id").alias("_d"), F.col("seq").alias("_s"), "depth", F.col("matrix").alias("_m"))
    drawn = marked.where("scope is null").drop("matrix").join(force, (F.col("drawing_id") == F.col("_d")) & (F.col("seq") == F.col("_s"))).withColumnRenamed("_m", "matrix")
    x, y = affine(F.col("origin_x"), F.col("origin_y"), F.col("matrix"))
    data = F.when(F.col("matrix").isNull(), F.col("data")).otherwise(transform_path(F.col("data"), F.col("matrix")))
    return drawn.withColumns({"data": data, "origin_x": x, "origin_y": y}).drop("drawing_id", "_d", "_s", "scope")


def to_origin(points: DataFrame) -> DataFrame:
    """Points moved so that each drawing's least x and y are 0."""
    least = points.groupBy("drawing_id").agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    return points.join(least, "drawing_id").withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y")}).drop("_x", "_y")


def _shape() -> W:
    return W.partitionBy("drawing_id", "shape_id").orderBy("pt")


def triangles(points: DataFrame) -> DataFrame:
    """The triangles i, i + 1, i + 2 of each strip; none for fewer than three points."""
    at = lambda c, k: F.lead(c, k).over(_shape()).alias(f"{c}{k}")
    return points.select("drawing_id", "shape_id", "pt", F.col("x").alias("x0"), F.col("y").alias("y0"), *[at(c, k) for k in (1, 2) for c in "xy"]).where("x2 is not null")


def bezier_groups(points: DataFrame) -> DataFrame:
    """Curves of three control points each after the first point; an incomplete tail is dropped."""
    member = lambda c, k: F.max(F.when((F.col("pt") - 1) % 3 == k, F.col(c))).alias(f"{c}{k + 1}")
    rest = points.where("pt >= 1").groupBy("drawing_id", "shape_id", F.floor((F.col("pt") - 1) / 3).alias("curve"))
    return rest.agg(F.count("*").alias("n"), *[member(c, k) for k in range(3) for c in "xy"]).where("n = 3").drop("n")


def segments(points: DataFrame, filled: Column | None = None) -> DataFrame:
    """Consecutive pairs of points; where filled holds, the last point leads back to the first."""
    nxt = {c: F.lead(c).over(_shape()) for c in "xy"}
    if filled is not None:
        nxt = {c: F.coalesce(n, F.when(filled, F.first(c).over(_shape()))) for c, n in nxt.items()}
    return points.select("drawing_id", "shape_id", "pt", "x", "y", nxt["x"].alias("to_x"), nxt["y"].alias("to_y")).where("to_x is not null")


def coord_profile(points: DataFrame) -> DataFrame:
    """For each field of each drawing: least and largest value, their number, and whether a record with a relative flag is among them."""
    flag = F.col("relative") if "relative" in points.columns else F.lit(None).cast("boolean")
    long = points.select("drawing_id", flag.alias("relative"), F.expr("stack(2, 'x', x, 'y', y) as (field, value)"))
    return long.groupBy("drawing_id", "field").agg(
        F.min("value").alias("least"), F.max("value").alias("largest"), F.count("value").alias("n"), F.coalesce(F.bool_or("relative"), F.lit(False)).alias("relative")
    )


def flat_colours(vertices: DataFrame, n: int = 3) -> DataFrame:
    """Mean r, g, b of each triangle (n 3, by groups of three) or segment (n 2, by consecutive pairs); incomplete ones dropped."""
    if n == 3:
        each = vertices.groupBy("drawing_id", "shape_id", F.floor(F.col("pt") / 3).alias("part"))
        return each.agg(*[F.avg(c).alias(c) for c in "rgb"], F.count("*").alias("_n")).where("_n = 3").drop("_n")
    mean = [((F.col(c) + F.lead(c).over(_shape())) / 2).alias(c) for c in "rgb"]
    return vertices.select("drawing_id", "shape_id", F.col("pt").alias("part"), *mean).where("r is not null")


def drawable(shapes: DataFrame) -> DataFrame:
    """Shapes (kind, points, text) that have what their kind needs."""
    n = F.coalesce(F.size("points"), F.lit(0))
    need = F.when(F.col("kind") == "polyline", n >= 1).when(F.col("kind").isin("polygon", "polytriangle"), n >= 3)
    need = need.when(F.col("kind") == "quad", n == 4).when(F.col("kind") == "bezier", n >= 4).when(F.col("kind") == "text", F.coalesce(F.length("text"), F.lit(0)) > 0)
    return shapes.where(F.coalesce(need, F.lit(True)))


def nearest_page(dims: DataFrame) -> DataFrame:
    """dims (width, height) with page, distance: the standard page at the least sum of differences, portrait or landscape, the first of equals, if under NEAR_PAGE.

    The 26 fixed candidates are tried inside each row, so nothing is joined or shuffled.
    """
    sizes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for k, (name, a, b) in enumerate(PAGES) for w, h in ((a, b), (b, a))])
    far = lambda s: F.abs(F.col("width") - s["w"]) + F.abs(F.col("height") - s["h"])
    best = F.array_min(F.transform(sizes, lambda s: F.struct(far(s).alias("distance"), s["k"].alias("k"), s["name"].alias("name"))))
    return dims.withColumn("_b", best).select("*", F.when(F.col("_b.distance") < NEAR_PAGE, F.col("_b.name")).alias("page"), F.col("_b.distance").alias("distance")).drop("_b")


def compare_pages(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes against their target pages (drawing_id, page_width, page_height): ratio difference in percent, class, scales."""
    ratio = lambda w, h: F.coalesce(F.try_divide(w, h), F.lit(0.0))
    both = boxes.join(pages, "drawing_id").withColumn("percent", F.coalesce(F.try_divide(100 * F.abs(ratio("width", "height") - ratio("page_width", "page_height")), ratio("page_width", "page_height")), F.lit(0.0)))
    return both.select("*", match_class(F.col("percent")).alias("match"), F.try_divide("page_width", "width").alias("scale_x"), F.try_divide("page_height", "height").alias("scale_y"))


def match_class(percent: Column) -> Column:
    return F.when(percent < 1, "match").when(percent < 5, "close").otherwise("mismatch")


def page_summary(pages: DataFrame) -> DataFrame:
    """Mean width and height, ratio of the means, and number of the pages of each file."""
    return pages.groupBy("file").agg(F.avg("width").alias("width"), F.avg("height").alias("height"), F.count("*").alias("pages")).withColumn("ratio", F.coalesce(F.try_divide("width", "height"), F.lit(0.0)))
