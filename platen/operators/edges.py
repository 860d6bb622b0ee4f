"""Edges of rectangles, curves and lines; snapping and joining them; edges implied by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clean, overlap
from ..schema import PAGE
from .cluster import with_cluster

EDGE = ["doc_id", "page_number", "seq", "part", "object_type", "orientation", "x0", "x1", "top", "bottom", "doctop", "width", "height"]


def _edge(**values) -> Column:
    return F.struct(*(v.alias(k) for k, v in values.items()))


def _spread(df: DataFrame, edges: Column) -> DataFrame:
    out = df.select(*PAGE, "seq", F.posexplode(edges).alias("part", "e")).select(*PAGE, "seq", "part", "e.*")
    return out.select(*PAGE, "seq", "part", "object_type", "orientation", *(clean(c).alias(c) for c in ("x0", "x1", "top", "bottom", "doctop", "width", "height")))


def _rect() -> Column:
    kind, zero = F.lit("rect_edge"), F.lit(0.0)
    x0, x1, top, bottom, doctop, width, height = (F.col(c) for c in ("x0", "x1", "top", "bottom", "doctop", "width", "height"))
    down = top + height

    def make(orientation, x0, x1, top, bottom, doctop, width, height):
        return _edge(object_type=kind, orientation=F.lit(orientation), x0=x0, x1=x1, top=top, bottom=bottom, doctop=doctop, width=width, height=height)

    return F.array(
        make("h", x0, x1, top, top, doctop, width, zero), make("h", x0, x1, down, bottom, doctop + height, width, zero),
        make("v", x0, x0, top, bottom, doctop, zero, height), make("v", x1, x1, top, bottom, doctop, zero, height),
    )


def _curve() -> Column:
    n = F.size("pts")
    first, last = F.get("pts", F.lit(0)), F.get("pts", n - 1)
    open_end = F.col("closepath") & ((n == 1) | ((n > 1) & ((first["x"] != last["x"]) | (first["y"] != last["y"]))))
    points = F.when(F.coalesce(open_end, F.lit(False)), F.concat(F.col("pts"), F.slice("pts", 1, 1))).otherwise(F.col("pts"))
    pairs = F.arrays_zip(F.slice(points, F.lit(1), F.size(points) - 1).alias("a"), F.slice(points, F.lit(2), F.size(points) - 1).alias("b"))

    def one(p):
        a, b = p["a"], p["b"]
        x0, x1, top, bottom = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
        way = F.when(a["x"] == b["x"], "v").when(a["y"] == b["y"], "h")
        return _edge(object_type=F.lit("curve_edge"), orientation=way, x0=x0, x1=x1, top=top, bottom=bottom, doctop=top + (F.col("doctop") - F.col("top")), width=x1 - x0, height=bottom - top)

    return F.when(n > 0, F.transform(pairs, one))


def _own(orientation: Column) -> Column:
    """The row itself as an edge."""
    return F.array(_edge(object_type=F.col("object_type"), orientation=orientation, **{c: F.col(c) for c in ("x0", "x1", "top", "bottom", "doctop", "width", "height")}))


def _line() -> Column:
    return _own(F.when(F.col("top") == F.col("bottom"), "h").otherwise("v"))


def rect_edges(rects: DataFrame) -> DataFrame:
    """Top, bottom, left and right of each rectangle."""
    return _spread(rects, _rect())


def curve_edges(curves: DataFrame) -> DataFrame:
    """One edge between each two points that follow each other, and back to the first of a closed curve. Slanted edges
    have no orientation."""
    return _spread(curves, _curve())


def line_edges(lines: DataFrame) -> DataFrame:
    """Each line as an edge: level ones h, all others v; the object type stays."""
    return _spread(lines, _line())


def object_edges(objects: DataFrame) -> DataFrame:
    """Edges of rect, curve and line rows, with an ``edge`` number by page: rectangles, curves, lines, and then rows that
    are edges already (of an object type with ``edge`` in it), as they are. One pass over the rows."""
    kind = F.col("object_type")
    made = F.when(kind == "rect", _rect()).when(kind == "line", _line())
    number = F.when(kind == "rect", 0).when(kind == "curve", 1).when(kind == "line", 2).otherwise(3)
    if "pts" in objects.columns:
        made = made.when(kind == "curve", _curve())
    if "orientation" in objects.columns:
        made = made.when(kind.contains("edge"), _own(F.col("orientation")))
    part = F.col("part") if "part" in objects.columns else F.lit(0)
    rows = objects.withColumns({"__kind": number, "__part": part})
    out = rows.select(*PAGE, "seq", "__kind", "__part", F.posexplode(made).alias("part", "e")).select(*PAGE, "seq", "__kind", "__part", "part", "e.*")
    out = out.select(*PAGE, "seq", "__kind", F.when(F.col("__kind") == 3, F.col("__part")).otherwise(F.col("part")).alias("part"), "object_type", "orientation", *(clean(c).alias(c) for c in ("x0", "x1", "top", "bottom", "doctop", "width", "height")))
    return out.withColumn("edge", F.row_number().over(Window.partitionBy(*PAGE).orderBy("__kind", "seq", "part")) - 1).drop("__kind")


def page_edges(vectors: DataFrame) -> DataFrame:
    """All edges of a page's rect, curve and line rows."""
    return object_edges(vectors.drop("orientation"))


def filter_edges(edges: DataFrame, orientation: str | None = None, edge_type: str | None = None, min_length: float = 1) -> DataFrame:
    keep = F.when(F.col("orientation") == "v", F.col("height")).otherwise(F.col("width")) >= min_length
    if orientation:
        keep &= F.col("orientation") == orientation
    if edge_type:
        keep &= F.col("object_type") == edge_type
    return edges.filter(keep)


def snap_edges(edges: DataFrame, x_tolerance: float = 3, y_tolerance: float = 3) -> DataFrame:
    """Upright edges move to the mean x0 of their cluster, level ones to the mean top; others are dropped."""
    df = edges.filter("orientation IN ('v', 'h')")
    upright = F.col("orientation") == "v"
    by = [*PAGE, "orientation"]
    key = F.when(upright, F.col("x0")).otherwise(F.col("top"))
    df = with_cluster(df, key, F.when(upright, F.lit(float(x_tolerance))).otherwise(F.lit(float(y_tolerance))), by, "__c")
    moved = F.avg(key).over(Window.partitionBy(*by, "__c")) - key
    df = df.withColumn("__by", moved)
    across, down = F.when(upright, F.col("__by")).otherwise(F.lit(0.0)), F.when(upright, F.lit(0.0)).otherwise(F.col("__by"))
    shift = {c: clean(F.col(c) + across) for c in ("x0", "x1")} | {c: clean(F.col(c) + down) for c in ("top", "bottom", "doctop") if c in df.columns}
    return df.withColumns(shift).drop("__c", "__by")


def join_edges(edges: DataFrame, x_tolerance: float = 3, y_tolerance: float = 3) -> DataFrame:
    """Edges of one line that touch within the tolerance (of what came before, taken together) become one."""
    level = F.col("orientation") == "h"
    df = edges.withColumns({"__at": F.when(level, F.col("top")).otherwise(F.col("x0")), "__lo": F.when(level, F.col("x0")).otherwise(F.col("top")), "__hi": F.when(level, F.col("x1")).otherwise(F.col("bottom"))})
    by, gap = [*PAGE, "orientation", "__at"], F.when(level, F.lit(float(x_tolerance))).otherwise(F.lit(float(y_tolerance)))
    order = Window.partitionBy(*by).orderBy("__lo", "__hi", "seq", "part")
    reach = F.max("__hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((F.col("__lo") > reach + gap).cast("int"), F.lit(0)))
    df = df.withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(*by, "__group").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    return out.select(*PAGE, "orientation", "x0", "x1", "top", "bottom", clean(F.col("x1") - F.col("x0")).alias("width"), clean(F.col("bottom") - F.col("top")).alias("height"))


def merge_edges(edges: DataFrame, snap: tuple[float, float] = (3, 3), join: tuple[float, float] = (3, 3)) -> DataFrame:
    """Snapped and then joined edges; tolerances as (x, y). Dealt by page once: all that follows keeps to that."""
    edges = edges.repartition(*PAGE)
    snapped = snap_edges(edges, *snap) if max(snap) > 0 else edges
    return join_edges(snapped, *join)


def words_to_edges_h(words: DataFrame, threshold: int = 1) -> DataFrame:
    """Upper and lower edges of the clusters of words of one top, as wide as all of them."""
    df = with_cluster(words, "top", 1 - 1e-12, PAGE, "__c")
    rows = df.groupBy(*PAGE, "__c").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("l"), F.max("x1").alias("r"), F.min("top").alias("t"), F.max("bottom").alias("b")).filter(F.col("n") >= threshold)
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumn("x0", F.min("l").over(page)).withColumn("x1", F.max("r").over(page))
    rows = rows.select(*PAGE, "x0", "x1", F.explode(F.array("t", "b")).alias("top"))
    return rows.select(*PAGE, F.lit("edge").alias("object_type"), F.lit("h").alias("orientation"), clean("x0").alias("x0"), clean("x1").alias("x1"), clean("top").alias("top"), clean("top").alias("bottom"), clean(F.col("x1") - F.col("x0")).alias("width"), F.lit(0.0).alias("height"))


def words_to_edges_v(words: DataFrame, threshold: int = 3) -> DataFrame:
    """Upright edges at the left of the largest clusters (of left sides, right sides or middles) that do not overlap, and
    one at the right of all; a fold over each page's clusters, largest first."""
    centre = (F.col("x0") + F.col("x1")) / 2
    clusters = None
    for k, key in enumerate((F.col("x0"), F.col("x1"), centre)):
        c = with_cluster(words, key, 1.0, PAGE, "__c").groupBy(*PAGE, "__c").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
        c = c.filter(F.col("n") >= threshold).select(*PAGE, F.struct((-F.col("n")).alias("o"), F.lit(k).alias("k"), F.col("__c").alias("c"), "x0", "top", "x1", "bottom").alias("r"))
        clusters = c if clusters is None else clusters.unionByName(c)
    kept = clusters.groupBy(*PAGE).agg(F.array_sort(F.collect_list("r")).alias("all"))
    box = lambda r: (r["x0"], r["top"], r["x1"], r["bottom"])
    none = F.filter("all", lambda r: F.lit(False))
    kept = kept.withColumn("some", F.aggregate("all", none, lambda acc, r: F.when(F.exists(acc, lambda q: overlap(box(r), box(q))), acc).otherwise(F.concat(acc, F.array(r)))))
    some = F.col("some")
    most = lambda c, f: f(F.transform(some, lambda r: r[c]))
    kept = kept.select(*PAGE, most("x1", F.array_max).alias("right"), most("top", F.array_min).alias("top"), most("bottom", F.array_max).alias("bottom"), F.transform(some, lambda r: r["x0"]).alias("xs"))
    rows = kept.select(*PAGE, "top", "bottom", F.explode(F.concat("xs", F.array("right"))).alias("x0"))
    return rows.select(*PAGE, F.lit("edge").alias("object_type"), F.lit("v").alias("orientation"), clean("x0").alias("x0"), clean("x0").alias("x1"), clean("top").alias("top"), clean("bottom").alias("bottom"), F.lit(0.0).alias("width"), clean(F.col("bottom") - F.col("top")).alias("height"))
