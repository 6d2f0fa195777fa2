"""What the order of records implies: pen positions, carried and scoped state, numbers, paths and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kept import cut

#: seq values of a drawing that one task takes at most, where an operator carries values from part to part.
CHUNK = 100_000


def _upto(*keys: str, order=("seq",)) -> W:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """The rows whose keys are equal, nulls included; keys has the names in left and in right."""
    parts = [left[a].eqNullSafe(right[b]) for a, b in keys.items()]
    return reduce(lambda x, y: x & y, parts)


def _parted(rows: DataFrame, keys: list[str], seq: str, chunk: int) -> DataFrame:
    """rows with _g, what its part of chunk seq values goes by: one struct, whose equality holds for nulls too."""
    return rows.withColumn("_g", F.struct(*keys, F.floor(F.col(seq) / chunk).alias("_c")))


def _scanned(rows: DataFrame, within: dict[str, Column], totals: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """rows (with _g) with values running through their part, and what the parts before come to.

    within: windows over _g. totals: aggregates of those over a part, a row each. carried: windows over a group's parts, in order. The rows are
    dealt out by part once, for the windows, the totals and the join alike; only a row for each part goes further.
    """
    rows = rows.withColumns(within)
    sums = rows.groupBy("_g").agg(*[c.alias(k) for k, c in totals.items()])
    sums = sums.select(F.col("_g").alias("_p"), *[c.alias(k) for k, c in carried.items()])
    return rows.join(sums, F.col("_g") == F.col("_p"), "left").drop("_p")


def _parts(keys: list[str], upto: int = -1) -> W:
    """The parts of a group before one, or up to it."""
    return W.partitionBy(*[f"_g.{k}" for k in keys]).orderBy("_g._c").rowsBetween(W.unboundedPreceding, upto)


def _part(*more: str, order: list[str]) -> W:
    return W.partitionBy("_g", *more).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def running_sum(rows: DataFrame, value: dict[str, Column], keys: list[str], order: list[str], chunk: int | None = CHUNK, part: Column | None = None) -> DataFrame:
    """rows with running sums. A group is summed in parts of chunk seq values, so that one huge group isn't one task's; without chunk, whole.

    part gives the parts instead, where order's first column has too many rows of one value: it must ascend with order.
    """
    if not chunk:
        return rows.withColumns({k: F.sum(v).over(_upto(*keys, order=order)) for k, v in value.items()})
    # Kept under other names first: a value may read the column that it replaces.
    within = {f"_l{k}": F.sum(v).over(_part(order=order)) for k, v in value.items()}
    totals = {f"_t{k}": F.sum(v) for k, v in value.items()}
    parted = _parted(rows, keys, order[0], chunk) if part is None else rows.withColumn("_g", F.struct(*keys, part.alias("_c")))
    out = _scanned(parted, within, totals, {f"_b{k}": F.sum(f"_t{k}").over(_parts(keys)) for k in value})
    return out.withColumns({k: F.coalesce(F.col(f"_l{k}") + F.col(f"_b{k}"), f"_l{k}", f"_b{k}") for k in value}).drop("_g", *[f"_{x}{k}" for k in value for x in "lb"])


def running_last(rows: DataFrame, value: dict[str, Column], keys: list[str], order: list[str], chunk: int | None = CHUNK) -> DataFrame:
    """rows with the last value so far that is not null, by parts as in running_sum."""
    if not chunk:
        return rows.withColumns({k: F.last(v, ignorenulls=True).over(_upto(*keys, order=order)) for k, v in value.items()})
    within = {f"_l{k}": F.last(v, ignorenulls=True).over(_part(order=order)) for k, v in value.items()}
    totals = {f"_t{k}": F.max_by(v, F.when(v.isNotNull(), F.struct(*order))) for k, v in value.items()}
    out = _scanned(_parted(rows, keys, order[0], chunk), within, totals, {f"_b{k}": F.last(f"_t{k}", ignorenulls=True).over(_parts(keys)) for k in value})
    return out.withColumns({k: F.coalesce(f"_l{k}", f"_b{k}") for k in value}).drop("_g", *[f"_{x}{k}" for k in value for x in "lb"])


def to_absolute(points: DataFrame, centers: bool = False, chunk: int | None = CHUNK) -> DataFrame:
    """points (drawing_id, seq, pt, kind, x, y) with ax, ay, their absolute places.

    kind origin sets the pen; rel moves it by (x, y) and lies there; rel_center does so only with centers, and else lies
    off the pen without moving it; abs lies at (x, y) and leaves the pen alone. The pen starts at (0, 0).
    """
    keys = ["drawing_id", "_seg"]
    moves = ["origin", "rel", "rel_center"] if centers else ["origin", "rel"]
    step = lambda c: F.when(F.col("kind").isin(moves), F.col(c)).otherwise(0)
    seg = running_sum(points, {"_seg": (F.col("kind") == "origin").cast("long")}, ["drawing_id"], ["seq", "pt"], chunk)
    pen = running_sum(seg, {"ax": step("x"), "ay": step("y")}, keys, ["seq", "pt"], chunk).drop("_seg")
    place = lambda a, c: F.when(F.col("kind") == "abs", F.col(c)).when(F.col("kind").isin(moves), F.col(a)).otherwise(F.col(a) + F.col(c))
    return pen.withColumns({"ax": place("ax", "x"), "ay": place("ay", "y")})


def carry_state(ops: DataFrame, attrs: dict, chunk: int | None = CHUNK) -> DataFrame:
    """Each attribute at its last set value in the drawing, else its default; a huge drawing is dealt out in parts of chunk seq values."""
    carried = running_last(ops, {a: F.col(a) for a in attrs}, ["drawing_id"], ["seq"], chunk)
    return carried.withColumns({a: F.coalesce(a, F.lit(d)) for a, d in attrs.items()})


def _depths(ops: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ops (drawing_id, seq, scope in save, restore, reset or null) with epoch, low (the least running sum, at most 0) and depth.

    Parts of a drawing are scanned on their own. What one hands on is its number of resets, and since the last of them the sum of its steps and the
    least running sum; those compose, and what comes before a part's first reset is moved by what was handed on.
    """
    saved, restored, reset = (F.coalesce(F.col("scope") == x, F.lit(False)) for x in ("save", "restore", "reset"))
    order, at, far = ["seq"], ["drawing_id"], F.struct("_e", "seq")
    rows = _parted(ops, at, "seq", chunk).withColumns({
        "_e": F.count_if(reset).over(_part(order=order)), "delta": F.when(saved, 1).when(restored, -1).otherwise(0).cast("long"),
    }).withColumn("_s", F.sum("delta").over(_part("_e", order=order)))
    totals = {"_resets": F.max("_e"), "_sum": F.max_by("_s", far), "_low": F.min_by("_m", F.struct((-F.col("_e")).alias("e"), "_m"))}
    sums = rows.withColumns({"_m": F.min("_s").over(_part("_e", order=order))}).groupBy("_g").agg(*[c.alias(k) for k, c in totals.items()])
    # Parts since the last one with a reset, that one included, add up.
    sums = sums.withColumn("_run", F.sum((F.col("_resets") > 0).cast("int")).over(_parts(at, 0)))
    run = W.partitionBy("_g.drawing_id", "_run").orderBy("_g._c").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("_total", F.sum("_sum").over(run)).withColumn("_least", F.min(F.col("_total") - F.col("_sum") + F.least(F.lit(0), "_low")).over(run))
    prior = W.partitionBy("_g.drawing_id").orderBy("_g._c")
    sums = sums.select(F.col("_g").alias("_p"), F.coalesce(F.sum("_resets").over(_parts(at)), F.lit(0)).alias("_r"), *[F.coalesce(F.lag(c).over(prior), F.lit(0)).alias(k) for c, k in (("_total", "_s0"), ("_least", "_m0"))])
    rows = rows.withColumn("_m", F.min("_s").over(_part("_e", order=order))).join(sums, F.col("_g") == F.col("_p"), "left")
    on = F.col("_e") == 0
    s = F.col("_s") + F.when(on, F.col("_s0")).otherwise(0)
    low = F.least(F.lit(0), F.col("_m") + F.when(on, F.col("_s0")).otherwise(0), F.when(on, F.col("_m0")).otherwise(0))
    rows = rows.withColumns({"epoch": F.col("_r") + F.col("_e"), "low": low, "depth": s - low})
    return rows.drop("_e", "_s", "_m", "_p", "_r", "_s0", "_m0", "delta")


def stack_audit(ops: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each drawing: saves, restores, restores of an empty stack, saves never restored, and the greatest depth. Huge drawings are scanned by parts."""
    each = _depths(ops, chunk).groupBy("drawing_id", "epoch").agg(
        F.count_if(F.col("scope") == "save").alias("saves"), F.count_if(F.col("scope") == "restore").alias("restores"),
        F.min("low").alias("low"), F.max_by("depth", "seq").alias("open"), F.max("depth").alias("deepest"),
    )
    return each.groupBy("drawing_id").agg(
        F.sum("saves").alias("saves"), F.sum("restores").alias("restores"), F.sum(-F.col("low")).alias("underflows"), F.sum("open").alias("unmatched"), F.max("deepest").alias("max_depth"),
    )


def _framed(ops: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ops with depth, opener (the seq of the save that opened the scope which a record lies in; null outside all scopes) and outer.

    Saves come twice: with outer, for the place in the scope around them where they stand, and without, for the scope that they open. Of the
    records of one level, those up to the next save that reaches this level lie in the same scope. A part takes the openers that its records lack
    from the parts before: a row for each level that a part needs or opens, whatever the number of its records. Rows that come with their opener stay as they are.
    """
    if "opener" in ops.columns:
        return ops
    rows = cut(_depths(ops, chunk)).withColumn("_save", F.coalesce(F.col("scope") == "save", F.lit(False)))
    places = F.when(F.col("_save"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("outer", F.explode(places)).withColumn("level", F.col("depth") - F.col("outer").cast("int"))
    opens = F.when(F.col("_save") & ~F.col("outer"), F.col("seq"))
    rows = rows.withColumn("_own", F.last(opens, ignorenulls=True).over(_part("epoch", "level", order=["seq", "outer"])))
    known = rows.where("level > 0").groupBy("_g", "epoch", "level").agg(F.max(opens).alias("_opened"), F.bool_or(F.col("_own").isNull()).alias("_lacks"))
    w = W.partitionBy("_g.drawing_id", "epoch", "level").orderBy("_g._c").rowsBetween(W.unboundedPreceding, -1)
    lent = known.withColumn("_lent", F.last("_opened", ignorenulls=True).over(w)).where("_lacks").select(F.col("_g").alias("_p"), F.col("epoch").alias("_pe"), F.col("level").alias("_pl"), "_lent")
    rows = rows.join(lent, (F.col("_g") == F.col("_p")) & (F.col("epoch") == F.col("_pe")) & (F.col("level") == F.col("_pl")), "left")
    return rows.withColumn("opener", F.coalesce("_own", "_lent")).drop("_own", "_lent", "_p", "_pe", "_pl", "_g", "_save", "low", "level")


def framed(ops: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The scopes of ops, kept. carry_scoped, group_path and inherit_matrix take them in place of ops, so that several values need them found only once."""
    return cut(_framed(ops, chunk))


def _climb(scopes: DataFrame, fold, done) -> DataFrame:
    """scopes (drawing_id, at, up, acc) -> drawing_id, at and acc of the scope and all around it that done does not cut off.

    Pointers jump twice as far at each step: fold(outer acc, own acc) takes in what the scope pointed to has gathered, and its pointer. As many steps as
    the logarithm of the depth, each a join of scopes alone; records take no part.
    """
    rest = cut(scopes.withColumn("up", F.when(~done(F.col("acc")), F.col("up"))))
    found = []
    while True:
        found.append(rest.where("up is null").select("drawing_id", "at", "acc"))
        live = rest.where("up is not null")
        if live.isEmpty():
            return reduce(DataFrame.union, found)
        outer = reduce(DataFrame.union, [*[f.withColumn("up", F.lit(None).cast("long")) for f in found], live.select("drawing_id", "at", "acc", "up")])
        o = outer.select(F.col("drawing_id").alias("_d"), F.col("at").alias("_at"), F.col("acc").alias("_acc"), F.col("up").alias("_up"))
        on = live.join(o, live["drawing_id"].eqNullSafe(o["_d"]) & (live["up"] == o["_at"]), "left")
        acc = fold(F.col("_acc"), F.col("acc"))
        rest = cut(on.select("drawing_id", "at", acc.alias("acc"), F.when(~done(acc), F.col("_up")).alias("up")))


def _with_scope(framed: DataFrame, scopes: DataFrame) -> DataFrame:
    """Records of framed with acc of the scope that each lies in. Those outside all scopes are dealt out evenly, and find none."""
    records = framed.where("NOT outer").withColumn("_deal", F.when(F.col("opener").isNull(), F.pmod(F.xxhash64("seq"), F.lit(1024))).otherwise(0))
    s = scopes.select(F.col("drawing_id").alias("_d"), F.col("at").alias("_at"), "acc", F.lit(0).cast("long").alias("_dealt"))
    return records.join(s, records["drawing_id"].eqNullSafe(s["_d"]) & (records["opener"].eqNullSafe(s["_at"])) & (records["_deal"] == s["_dealt"]), "left").drop("_d", "_at", "_deal", "_dealt")


def _gathered(ops: DataFrame, own: Column, fold, chunk: int) -> DataFrame:
    """Records with acc: own of the saves of all open scopes, folded from the outermost inwards; null where none is open."""
    framed = ops if "opener" in ops.columns else cut(_framed(ops, chunk))
    # opener of a save is itself where it opens, and the scope around it where it stands.
    scopes = framed.where("outer").select("drawing_id", F.col("seq").alias("at"), F.col("opener").alias("up"), own.alias("acc"))
    return _with_scope(framed, _climb(scopes, fold, lambda acc: F.lit(False)))


def carry_scoped(ops: DataFrame, attr: str, default, chunk: int = CHUNK) -> DataFrame:
    """attr at the value in force: save keeps all, restore brings back what was, reset clears values and scopes.

    A value set on a save belongs to what it opens. In force is the last value set in the record's own scope, else what
    was in force where that scope was opened, found by pointers from scope to scope that stop at the first with a value. No stack is walked, and depth costs its logarithm.
    """
    setting = F.when(~F.col("outer"), F.col(attr))
    framed = cut(running_last(_framed(ops, chunk), {"_here": F.when(setting.isNotNull(), F.struct(setting.alias("v")))}, ["drawing_id", "epoch", "opener"], ["seq", "outer"], chunk))
    scopes = framed.where("outer").select("drawing_id", F.col("seq").alias("at"), F.col("opener").alias("up"), F.col("_here").alias("acc"))
    found = _with_scope(framed, _climb(scopes, lambda outer, own: F.coalesce(own, outer), lambda acc: acc.isNotNull()))
    return found.select("drawing_id", "seq", "depth", F.coalesce("_here.v", "acc.v", F.lit(default)).alias(attr))


def group_path(ops: DataFrame, name: str, chunk: int = CHUNK) -> DataFrame:
    """The names of the open groups of each record, outermost first, joined by slashes; the record that opens a group is inside it. Null names are left out."""
    names = F.when(F.col(name).isNotNull(), F.array(F.col(name))).otherwise(F.array().cast("array<string>"))
    found = _gathered(ops, names, lambda outer, own: F.concat(outer, own), chunk)
    return found.select("drawing_id", "seq", F.coalesce(F.array_join("acc", "/"), F.lit("")).alias("path"))


def inherit_matrix(elements: DataFrame, compose: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The matrix of the nearest open canvas that has one. elements: scope save opens a canvas (with matrix or null), restore closes it.

    compose multiplies the matrices of all open canvases, outermost first, instead; a canvas without one leaves what is around it as it is.
    """
    if not compose:
        return carry_scoped(elements, "matrix", None, chunk)
    both = lambda outer, own: F.when(outer.isNull(), own).when(own.isNull(), outer).otherwise(multiply(own, outer))
    return _gathered(elements, F.col("matrix"), both, chunk).select("drawing_id", "seq", "depth", F.col("acc").alias("matrix"))


def multiply(m: Column, n: Column) -> Column:
    """The affine map that does m, then n; six numbers each."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    return F.array(a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


def node_numbers(ops: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """ops (kind base, delta or auto; value) with node: a base sets it, a delta adds, auto adds 1; null before the first base."""
    step = F.when(F.col("kind") == "delta", F.col("value")).when(F.col("kind") == "auto", 1).otherwise(0)
    summed = running_sum(ops, {"_s": step}, ["drawing_id"], ["seq"], chunk)
    # A base starts from its value less the steps before it.
    from_ = F.when(F.col("kind") == "base", F.col("value") - F.col("_s"))
    return running_last(summed, {"_from": from_}, ["drawing_id"], ["seq"], chunk).withColumn("node", F.col("_from") + F.col("_s")).drop("_s", "_from")


def resolve_palette(ops: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """ops with palette (array) where one is defined and idx where one is used: colour, the entry of the last palette before; null outside it."""
    found = running_last(ops, {"_p": F.col("palette")}, ["drawing_id"], ["seq"], chunk)
    return found.withColumn("colour", F.when(F.col("idx") >= 0, F.try_element_at("_p", (F.col("idx") + 1).cast("int")))).drop("_p")


def resolve_refs(ops: DataFrame, key: str, value: str, chunk: int | None = CHUNK) -> DataFrame:
    """value as last defined for the record's key in its drawing; an empty or null value refers."""
    return running_last(ops, {value: F.nullif(F.col(value), F.lit(""))}, ["drawing_id", key], ["seq"], chunk)


def path_vertices(paths: DataFrame, data: str = "data") -> DataFrame:
    """paths (drawing_id, shape_id, data) -> a vertex for each command of a path text.

    M and L are absolute, m and l relative, H, V, h and v move one axis, Z returns to the start; the first pair of a command counts.
    """
    number = r"-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    tokens = F.regexp_extract_all(F.col(data), F.lit(r"[MmLlHhVvZz][^A-DF-Za-df-z]*"), F.lit(0))
    rows = paths.select("drawing_id", "shape_id", F.posexplode(tokens).alias("pt", "token"))
    cmd = F.substring("token", 1, 1)
    nums = F.transform(F.regexp_extract_all("token", F.lit(number), F.lit(0)), lambda x: x.cast("double"))
    first, second = F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
    rows = rows.select("drawing_id", "shape_id", "pt", cmd.alias("cmd"), F.when(F.upper(cmd) != "V", first).alias("px"), F.when(F.upper(cmd) == "V", first).otherwise(second).alias("py"))
    # A subpath starts at each M or m; Z goes back to its start.
    keys = ["drawing_id", "shape_id"]
    w = W.partitionBy(*keys).orderBy("pt").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows
    for axis, still, p in (("x", "VvZz", "px"), ("y", "HhZz", "py")):
        absolute = F.col("cmd").isin("M", "L", "H" if axis == "x" else "V")
        moves = F.when(F.instr(F.lit(still), F.col("cmd")) > 0, 0.0).otherwise(F.coalesce(F.col(p), F.lit(0.0)))
        out = out.withColumn(f"_s{axis}", F.sum(absolute.cast("int")).over(w)).withColumn(f"_v{axis}", moves)
        seg = W.partitionBy(*keys, f"_s{axis}").orderBy("pt").rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumn(axis, F.sum(f"_v{axis}").over(seg))
    start = lambda c: F.last(F.when(F.col("cmd").isin("M", "m"), F.col(c)), ignorenulls=True).over(w)
    back = {c: F.when(F.upper("cmd") == "Z", start(c)).otherwise(F.col(c)) for c in "xy"}
    return out.withColumns(back).select("drawing_id", "shape_id", "pt", "cmd", "x", "y")


def page_index(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """Pages of each file in the order of path, from 0, with a break before all but the first; equal paths in any order.

    Pages are sorted in ranges over all files, and each range learns how many pages of its files the ranges before hold: one file may fill many tasks.
    """
    n = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("file").asc_nulls_first(), F.col("path").asc_nulls_first(), F.xxhash64(*pages.columns)]
    ids = F.monotonically_increasing_id()
    ranged = cut(pages.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", ids)).withColumn("_pid", F.shiftright("_id", 33))
    held = ranged.groupBy("file", "_pid").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("file").alias("_f"), F.col("_pid").alias("_p"), "_first", before.alias("_before"))
    placed = ranged.join(held, ranged["file"].eqNullSafe(held["_f"]) & (ranged["_pid"] == held["_p"]))
    out = placed.withColumn("index", F.col("_before") + F.col("_id") - F.col("_first"))
    return out.withColumn("break_before", F.col("index") > 0).drop("_id", "_pid", "_f", "_p", "_first", "_before")
