"""Cropping, filtering and moving of boxes, and de-duplication of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clean, overlap
from ..schema import PAGE
from .cluster import with_cluster


def check_box(box: tuple, inside: tuple | None = None, strict: bool = True) -> None:
    """Raises ValueError for a box without area, or (strict) not fully inside the other one."""
    x0, top, x1, bottom = box
    if x1 - x0 < 0 or bottom - top < 0:
        raise ValueError(f"bounding box {box} has a negative side")
    if (x1 - x0) * (bottom - top) == 0:
        raise ValueError(f"bounding box {box} has no area")
    if inside is not None and strict:
        if x0 >= inside[2] or x1 <= inside[0] or top >= inside[3] or bottom <= inside[1]:
            raise ValueError(f"bounding box {box} is outside the page's {inside}")
        if x0 < inside[0] or top < inside[1] or x1 > inside[2] or bottom > inside[3]:
            raise ValueError(f"bounding box {box} is not fully within the page's {inside}")


def _columns(box) -> list[Column]:
    return [F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in box]


def _have(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({k: clean(v) for k, v in values.items() if k in df.columns})


def crop(df: DataFrame, box) -> DataFrame:
    """Rows that overlap the box, clipped to it; points and paths stay as they are."""
    b = _columns(box)
    df = df.filter(overlap(tuple(b)))
    x0, top = F.greatest(F.col("x0"), b[0]), F.greatest(F.col("top"), b[1])
    x1, bottom = F.least(F.col("x1"), b[2]), F.least(F.col("bottom"), b[3])
    moved = top - F.col("top")
    return _have(df, {
        "x0": x0, "top": top, "x1": x1, "bottom": bottom, "doctop": F.col("doctop") + moved if "doctop" in df.columns else top,
        "width": x1 - x0, "height": bottom - top,
        "y0": F.col("y0") - (bottom - F.col("bottom")) if "y0" in df.columns else top, "y1": F.col("y1") - moved if "y1" in df.columns else top,
    })


def within(df: DataFrame, box) -> DataFrame:
    """Rows that lie fully in the box, to six decimals."""
    b = _columns(box)
    same = (clean(F.greatest(F.col("x0"), b[0])) == clean("x0")) & (clean(F.greatest(F.col("top"), b[1])) == clean("top"))
    same &= (clean(F.least(F.col("x1"), b[2])) == clean("x1")) & (clean(F.least(F.col("bottom"), b[3])) == clean("bottom"))
    return df.filter(overlap(tuple(b)) & same)


def outside(df: DataFrame, box) -> DataFrame:
    """Rows that do not overlap the box."""
    return df.filter(~overlap(tuple(_columns(box))))


#: Side of the squares of the grid that brings boxes of a page together.
GRID = 100.0


def _squares(low, high) -> Column:
    """Numbers of the grid's rows or columns from one place to another."""
    first, last = F.floor(low / GRID), F.floor(high / GRID)
    return F.sequence(first, F.greatest(first, last))


def on_grid(df: DataFrame, box: tuple = ("x0", "top", "x1", "bottom")) -> DataFrame:
    """``df`` once for each square that the box touches, with the square's column and row as __gx and __gy."""
    x0, top, x1, bottom = _columns(box)
    return df.withColumn("__gx", F.explode(_squares(x0, x1))).withColumn("__gy", F.explode(_squares(top, bottom)))


def within_any(df: DataFrame, boxes: DataFrame, inside: bool = True) -> DataFrame:
    """Rows that overlap (or not) any box of their page. Rows and boxes meet by page and square of the grid, so a dense page
    costs what is near each other; a row is told from the others by page, object type and seq."""
    sides = ("x0", "top", "x1", "bottom")
    keys = [*PAGE, *(k for k in ("object_type", "seq") if k in df.columns)]
    b = on_grid(boxes.select(*PAGE, *(F.col(c).alias(f"b_{c}") for c in sides)), tuple(f"b_{c}" for c in sides))
    near = on_grid(df.select(*keys, *sides)).join(b, [*PAGE, "__gx", "__gy"])
    hits = near.filter(overlap(tuple(f"b_{c}" for c in sides))).select(*keys).distinct()
    on = [df[k].eqNullSafe(hits[k]) if k not in PAGE else df[k] == hits[k] for k in keys]
    return df.join(hits, on, "left_semi" if inside else "left_anti")


def bounding_box(df: DataFrame, by: list = PAGE) -> DataFrame:
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def move(df: DataFrame, axis: str, by: Column) -> DataFrame:
    """Moves rows to the right (h) or down (v)."""
    if axis == "h":
        return _have(df, {"x0": F.col("x0") + by, "x1": F.col("x1") + by})
    down = {c: F.col(c) + by for c in ("top", "bottom", "doctop") if c in df.columns}
    return _have(df, down | {c: F.col(c) - by for c in ("y0", "y1") if c in df.columns})


def resize(df: DataFrame, side: str, value: Column) -> DataFrame:
    """Sets one side, and what depends on it."""
    out = {side: value}
    if side in ("x0", "x1"):
        out["width"] = value - F.col("x0") if side == "x1" else F.col("x1") - value
    elif side == "top":
        by = value - F.col("top")
        out |= {"height": F.col("bottom") - value} | ({"doctop": F.col("doctop") + by} if "doctop" in df.columns else {}) | ({"y1": F.col("y1") - by} if "y1" in df.columns else {})
    else:
        out |= {"height": value - F.col("top")} | ({"y0": F.col("y0") - (value - F.col("bottom"))} if "y0" in df.columns else {})
    return _have(df, out)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, limit: int | None = None, order: str = "seq") -> DataFrame:
    """A slice of each page's rows (negative: from the end), then at most ``limit`` of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*PAGE))
    df = df.withColumn("__i", F.row_number().over(Window.partitionBy(*PAGE).orderBy(order)) - 1).withColumn("__n", n)
    low = F.lit(0) if start is None else F.lit(start) if start >= 0 else F.greatest(F.col("__n") + start, F.lit(0))
    high = F.col("__n") if stop is None else F.lit(stop) if stop >= 0 else F.col("__n") + stop
    keep = (F.col("__i") >= low) & (F.col("__i") < high) & ((F.col("__i") - low) % step == 0)
    if limit is not None:
        keep &= F.floor((F.col("__i") - low) / step) < limit
    return df.filter(keep).drop("__i", "__n")


#: Rows of more columns than this don't go through the sorts of de-duplication themselves.
NARROW = 20


def dedupe(chars: DataFrame, tolerance: float = 1, extra_attrs: tuple = ("fontname", "size")) -> DataFrame:
    """Characters without those that repeat another's text and attributes within the tolerance, down and then across;
    the first by (doctop, x0) of each cluster stays.

    Three sorts find the repeats. Narrow rows go through them as they are. Of wide ones only keys and places do, and the
    repeats, which are few, are taken out by an anti join on page and seq, which is unique there.
    """
    keys = [*PAGE, "upright", "text", *(a for a in extra_attrs if a in chars.columns)]
    wide = len(chars.columns) > NARROW
    df = chars.select(*keys, "doctop", "x0", "seq") if wide else chars
    df = with_cluster(df, "doctop", tolerance, keys, "__down")
    df = with_cluster(df, "x0", tolerance, [*keys, "__down"], "__across")
    place = F.row_number().over(Window.partitionBy(*keys, "__down", "__across").orderBy("doctop", "x0", "seq"))
    df = df.withColumn("__place", place)
    if wide:
        return chars.join(df.filter("__place > 1").select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti")
    return df.filter("__place = 1").drop("__down", "__across", "__place")


def doctop_offsets(pages: DataFrame) -> DataFrame:
    """Adds the sum of the heights of the document's earlier pages."""
    over = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("doctop_offset", F.coalesce(F.sum("height").over(over), F.lit(0.0)))


def count_objects(df: DataFrame) -> DataFrame:
    return df.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


def mcid_text(chars: DataFrame) -> DataFrame:
    """The text of each marked-content id up to the page's largest, prefixed by its tag; ids without characters are empty."""
    made = chars.filter("mcid IS NOT NULL").groupBy(*PAGE, "mcid").agg(F.concat(F.coalesce(F.concat(F.min_by("tag", "seq"), F.lit(": ")), F.lit("")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")).alias("text"))
    every = made.groupBy(*PAGE).agg(F.max("mcid").alias("most")).select(*PAGE, F.explode(F.sequence(F.lit(0), "most")).alias("mcid"))
    return every.join(made, [*PAGE, "mcid"], "left").select(*PAGE, "mcid", F.coalesce("text", F.lit("")).alias("text"))
