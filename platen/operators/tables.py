"""Tables: edges, intersections, cells, components and cell texts."""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import holds_midpoint
from ..schema import PAGE
from .boxes import GRID, on_grid
from .cluster import with_cluster
from .edges import filter_edges, line_edges, merge_edges, object_edges, page_edges, words_to_edges_h, words_to_edges_v
from .words import WordOptions, extract_words

STRATEGIES = ("lines", "lines_strict", "text", "explicit")


@dataclass(frozen=True)
class TableSettings:
    """Explicit lines are numbers (lines across each page), objects as dicts or rows (lines, rectangles, curves or edges,
    on every page unless they name theirs), or a DataFrame of objects or edges, such as another set's edges."""

    vertical_strategy: str = "lines"
    horizontal_strategy: str = "lines"
    explicit_vertical_lines: tuple | DataFrame = ()
    explicit_horizontal_lines: tuple | DataFrame = ()
    snap_x_tolerance: float = 3
    snap_y_tolerance: float = 3
    join_x_tolerance: float = 3
    join_y_tolerance: float = 3
    edge_min_length: float = 3
    edge_min_length_prefilter: float = 1
    min_words_vertical: int = 3
    min_words_horizontal: int = 1
    intersection_x_tolerance: float = 3
    intersection_y_tolerance: float = 3
    text: WordOptions = field(default_factory=WordOptions)

    @classmethod
    def resolve(cls, **options) -> "TableSettings":
        """Settings from options by name: snap_, join_ and intersection_tolerance set both axes, text_... the words."""
        out, text, known = {}, {}, {f.name for f in fields(cls)} - {"text"}
        for kind in ("snap", "join", "intersection"):
            if (both := options.pop(f"{kind}_tolerance", None)) is not None:
                out |= {f"{kind}_x_tolerance": both, f"{kind}_y_tolerance": both}
        for k, v in options.items():
            if k.startswith("text_"):
                text[k[5:]] = v
            elif k in known:
                out[k] = tuple(v) if isinstance(v, list) else v
            else:
                raise TypeError(f"unknown table setting: {k}")
        if (both := text.pop("tolerance", None)) is not None:
            text = {"x_tolerance": both, "y_tolerance": both} | text
        made = cls(**out, text=WordOptions(**text))
        for axis in ("vertical", "horizontal"):
            if getattr(made, f"{axis}_strategy") not in STRATEGIES:
                raise ValueError(f"{axis}_strategy must be one of {', '.join(STRATEGIES)}")
            lines = getattr(made, f"explicit_{axis}_lines")
            if getattr(made, f"{axis}_strategy") == "explicit" and (lines.limit(2).count() if isinstance(lines, DataFrame) else len(lines)) < 2:
                raise ValueError(f"the explicit {axis}_strategy needs two lines or more")
        for f in fields(cls):
            if isinstance(v := getattr(made, f.name), (int, float)) and v < 0:
                raise ValueError(f"{f.name} cannot be negative")
        return made


_EDGE = ["doc_id", "page_number", "seq", "part", "object_type", "orientation", "x0", "x1", "top", "bottom", "width", "height"]


_OBJECT = "object_type string, orientation string, x0 double, x1 double, top double, bottom double, doctop double, width double, height double, pts array<struct<x:double,y:double>>, closepath boolean, own_doc long, own_page int"


def _described(x) -> tuple:
    """An explicit object as the fields of _OBJECT."""
    x = x.asDict() if hasattr(x, "asDict") else dict(x)
    points = [(float(p["x"]), float(p["y"])) if hasattr(p, "keys") else (float(p[0]), float(p[1])) for p in x.get("pts") or []]
    number = lambda k, other=0.0: float(x[k]) if x.get(k) is not None else other
    x0, x1, top, bottom = (number(k) for k in ("x0", "x1", "top", "bottom"))
    return (x["object_type"], x.get("orientation"), x0, x1, top, bottom, number("doctop", top), x1 - x0, bottom - top, points or None, bool(x.get("closepath")), x.get("doc_id"), x.get("page_number"))


def explicit_edges(lines, pages: DataFrame, way: str) -> list[DataFrame]:
    """Edges of one orientation from numbers and objects, on each page."""
    out, numbers, objects = [], [x for x in lines if isinstance(x, (int, float))], [_described(x) for x in lines if not isinstance(x, (int, float))]
    if numbers:
        b = lambda c: F.col(f"bbox.{c}")
        side = F.col("at")
        x0, x1, top, bottom = (side, side, b("top"), b("bottom")) if way == "v" else (b("x0"), b("x1"), side, side)
        at = pages.select(*PAGE, "bbox", F.explode(F.array(*[F.lit(float(x)) for x in numbers])).alias("at"))
        out.append(at.select(*PAGE, F.lit(0).alias("seq"), F.lit(0).alias("part"), F.lit("edge").alias("object_type"), F.lit(way).alias("orientation"), x0.alias("x0"), x1.alias("x1"), top.alias("top"), bottom.alias("bottom"), (x1 - x0).alias("width"), (bottom - top).alias("height")))
    if objects:
        names = [x.split()[0] for x in _OBJECT.split(", ")]
        texts = json.dumps([dict(zip(names, (*o[:9], o[9] and [{"x": x, "y": y} for x, y in o[9]], *o[10:]))) for o in objects])
        listed = F.from_json(F.lit(texts), "array<struct<" + _OBJECT.replace(" ", ": ").replace(",: ", ", ") + ">>")
        on = pages.select(*PAGE, F.posexplode(listed).alias("seq", "o")).select(*PAGE, "seq", "o.*")
        on = on.filter((F.col("own_doc").isNull() | (F.col("own_doc") == F.col("doc_id"))) & (F.col("own_page").isNull() | (F.col("own_page") == F.col("page_number"))))
        out.append(object_edges(on.drop("own_doc", "own_page")).filter(F.col("orientation") == way).select(*_EDGE))
    return out


def table_edges(vectors: DataFrame, chars: DataFrame | None = None, pages: DataFrame | None = None, s: TableSettings = TableSettings()) -> DataFrame:
    """The edges that tables are found from: by strategy for each axis, explicit lines always, then merged and filtered by length."""
    words = None
    if "text" in (s.vertical_strategy, s.horizontal_strategy):
        words = extract_words(chars, s.text)
    parts, ways = [], (("v", s.vertical_strategy, s.explicit_vertical_lines), ("h", s.horizontal_strategy, s.explicit_horizontal_lines))
    if usual := [way for way, strategy, _ in ways if strategy == "lines"]:  # both ways in one pass
        parts.append(filter_edges(page_edges(vectors), None, None, s.edge_min_length_prefilter).filter(F.col("orientation").isin(usual)).select(*_EDGE))
    for way, strategy, explicit in ways:
        base = None
        if strategy == "text":
            base = words_to_edges_v(words, s.min_words_vertical) if way == "v" else words_to_edges_h(words, s.min_words_horizontal)
            base = base.withColumn("seq", F.lit(0)).withColumn("part", F.lit(0))
        elif strategy == "lines_strict":
            base = filter_edges(line_edges(vectors.filter("object_type = 'line'")), way, "line", s.edge_min_length_prefilter)
        if base is not None:
            parts.append(base.select(*_EDGE))
        if isinstance(explicit, DataFrame):
            parts.append(object_edges(explicit).filter(F.col("orientation") == way).select(*_EDGE))
        elif explicit:
            parts += explicit_edges(explicit, pages, way)
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    merged = merge_edges(edges, (s.snap_x_tolerance, s.snap_y_tolerance), (s.join_x_tolerance, s.join_y_tolerance))
    return filter_edges(merged, None, None, s.edge_min_length)


def intersections(edges: DataFrame, x_tolerance: float = 3, y_tolerance: float = 3) -> DataFrame:
    """Points where upright and level edges meet: a join on the page with the ranges as residual."""
    v = edges.filter("orientation = 'v'").select(*PAGE, F.col("x0").alias("x"), F.col("top").alias("v_top"), F.col("bottom").alias("v_bottom"))
    h = edges.filter("orientation = 'h'").select(*PAGE, F.col("top").alias("y"), F.col("x0").alias("h_x0"), F.col("x1").alias("h_x1"))
    met = (F.col("v_top") <= F.col("y") + y_tolerance) & (F.col("v_bottom") >= F.col("y") - y_tolerance)
    met &= (F.col("x") >= F.col("h_x0") - x_tolerance) & (F.col("x") <= F.col("h_x1") + x_tolerance)
    on = [v[k] == h[k] for k in PAGE] + [met]
    hits = v.join(h, on).select(v["doc_id"], v["page_number"], "x", "y", F.struct("v_top", "v_bottom").alias("v"), F.struct("h_x0", "h_x1").alias("h"))
    return hits.groupBy(*PAGE, "x", "y").agg(F.collect_set("v").alias("v"), F.collect_set("h").alias("h"))


def find_cells(edges: np.ndarray, x_tolerance: float, y_tolerance: float) -> list[tuple]:
    """Cells (x0, top, x1, bottom) of one page's edges (upright, x0, x1, top, bottom): for each point the smallest box
    down and to the right whose four sides run along common edges."""
    uprights = sorted({(e[1], e[3], e[4]) for e in edges if e[0]})
    levels = sorted({(e[3], e[1], e[2]) for e in edges if not e[0]})
    if not uprights or not levels:
        return []
    ys = np.array([y for y, _, _ in levels])
    left, right = np.array([a for _, a, _ in levels]), np.array([b for _, _, b in levels])
    points: dict[tuple, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for i, (x, top, bottom) in enumerate(uprights):
        low, high = np.searchsorted(ys, top - y_tolerance, "left"), np.searchsorted(ys, bottom + y_tolerance, "right")
        near = slice(low, high)  # levels are in the order of their heights
        for j in (np.flatnonzero((left[near] - x_tolerance <= x) & (x <= right[near] + x_tolerance)) + low).tolist():
            v, h = points[x, levels[j][0]]
            v.add(i)
            h.add(j)
    below, beside = defaultdict(list), defaultdict(list)
    for x, y in sorted(points):
        below[x].append(y)
        beside[y].append(x)
    for xs in beside.values():
        xs.sort()
    out = []
    for (x, y), (v, h) in sorted(points.items(), key=lambda p: (p[0][1], p[0][0])):
        downs = [b for b in below[x] if b > y and points[x, b][0] & v]
        rights = [r for r in beside[y] if r > x and points[r, y][1] & h]
        cell = next(((x, y, r, b) for b in downs for r in rights if (r, b) in points and points[r, b][1] & points[x, b][1] and points[r, b][0] & points[r, y][0]), None)
        if cell:
            out.append(cell)
    return out


def group_cells(cells: list[tuple]) -> list[list[tuple]]:
    """Cells that share corners, directly or through others; groups of one are dropped; from top to bottom, left to right."""
    parent = list(range(len(cells)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple, int] = {}
    for i, (x0, top, x1, bottom) in enumerate(cells):
        for corner in ((x0, top), (x0, bottom), (x1, top), (x1, bottom)):
            parent[find(i)] = find(seen.setdefault(corner, i))
    groups = defaultdict(list)
    for i, c in enumerate(cells):
        groups[find(i)].append(c)
    return sorted((g for g in groups.values() if len(g) > 1), key=lambda g: min((c[1], c[0]) for c in g))


def cells_of_pages(edges: DataFrame, s: TableSettings = TableSettings(), largest: bool = False) -> DataFrame:
    """cells(doc_id, page_number, table_id, x0, top, x1, bottom), of all tables or the largest only. A page's edges are
    gathered, in the partitioning by page that merge_edges began with, and pages are worked through one at a time."""
    rows = edges.select(*PAGE, F.struct((F.col("orientation") == "v").cast("double").alias("upright"), "x0", "x1", "top", "bottom").alias("e"))
    x, y = s.intersection_x_tolerance, s.intersection_y_tolerance
    names = ["doc_id", "page_number", "table_id", "x0", "top", "x1", "bottom"]

    def run(batches):
        for batch in batches:
            lists = batch.column("all")
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()], axis=1)
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            out = []
            for doc, number, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("page_number").to_pylist(), ends, ends[1:]):
                groups = list(enumerate(group_cells(find_cells(values[a:b], x, y))))
                if largest and len(groups) > 1:  # as largest_table orders them
                    groups = [min(groups, key=lambda g: (-len(g[1]), min(c[1] for c in g[1]), min(c[0] for c in g[1]), g[0]))]
                for k, group in groups:
                    out += [(doc, number, k, *c) for c in group]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4))], names=names)

    pages = rows.groupBy(*PAGE).agg(F.collect_list("e").alias("all"))
    return pages.mapInArrow(run, "doc_id long, page_number int, table_id int, x0 double, top double, x1 double, bottom double")


def find_tables(vectors: DataFrame, chars: DataFrame | None = None, pages: DataFrame | None = None, s: TableSettings = TableSettings(), largest: bool = False) -> DataFrame:
    """Cells of the pages' tables, or of each page's largest one: then pages are worked through once, without a join."""
    return cells_of_pages(table_edges(vectors, chars, pages, s), s, largest)


def largest_table(cells: DataFrame) -> DataFrame:
    """The cells of each page's largest table: most cells, then the highest, then the leftmost."""
    tables = cells.groupBy(*PAGE, "table_id").agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("t"), F.min("x0").alias("l"))
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "t", "l", "table_id"))
    return cells.join(tables.withColumn("r", first).filter("r = 1").select(*PAGE, "table_id"), [*PAGE, "table_id"], "left_semi")


def with_axes(cells: DataFrame) -> DataFrame:
    """Cells with their row and column numbers: by distinct top and by distinct x0 of the table."""
    by = [*PAGE, "table_id"]
    return cells.withColumn("row", F.dense_rank().over(Window.partitionBy(*by).orderBy("top")) - 1).withColumn("col", F.dense_rank().over(Window.partitionBy(*by).orderBy("x0")) - 1)


def axis_groups(cells: DataFrame, axis: str = "row") -> DataFrame:
    """Rows (or columns) of tables with their boxes and numbers of cells."""
    return with_axes(cells).groupBy(*PAGE, "table_id", axis).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("n"))


def chars_in_cells(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Characters with the cell that holds their middle: a join on the page and the square of the grid that the middle is
    in, with the box as residual."""
    sides = tuple(f"c_{k}" for k in ("x0", "top", "x1", "bottom"))
    c = on_grid(cells.select(*PAGE, "table_id", *(F.col(k).alias(f"c_{k}") for k in ("x0", "top", "x1", "bottom"))), sides)
    middle = {"__gx": F.floor((F.col("x0") + F.col("x1")) / 2 / GRID), "__gy": F.floor((F.col("top") + F.col("bottom")) / 2 / GRID)}
    return chars.withColumns(middle).join(c, [*PAGE, "__gx", "__gy"]).filter(holds_midpoint(tuple(F.col(k) for k in sides))).drop("__gx", "__gy")


def cell_texts(chars: DataFrame, cells: DataFrame, o: WordOptions = WordOptions()) -> DataFrame:
    """Cells with their text: words, in clusters of lines, joined by spaces and newlines; '' where a cell has no character."""
    placed = with_axes(cells.repartition(*PAGE))  # both uses of the cells share this exchange, and all their windows keep to it
    key = F.row_number().over(Window.partitionBy(*PAGE).orderBy("table_id", "row", "col"))
    placed = placed.withColumn("cell", key)
    held = chars_in_cells(chars, placed.withColumn("table_id", F.col("cell")))
    # each cell is a page of its own for the word operators: page_number becomes (page, cell)
    held = held.withColumn("doc_id", F.struct("doc_id", "page_number")).withColumn("page_number", F.col("table_id"))
    words = with_cluster(extract_words(held, o), F.col("top") if o.line_dir == "ttb" else -F.col("bottom") if o.line_dir == "btt" else F.col("x0") if o.line_dir == "ltr" else -F.col("x1"), float(o.y_tolerance), PAGE, "__line")
    lines = words.groupBy(*PAGE, "__line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "text"))), lambda w: w["text"]), " ").alias("t"))
    texts = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__line", "t"))), lambda x: x["t"]), "\n").alias("text"))
    texts = texts.select("doc_id.doc_id", "doc_id.page_number", F.col("page_number").alias("cell"), "text")
    return placed.join(texts, [*PAGE, "cell"], "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("cell")


def extract_tables(chars: DataFrame, cells: DataFrame, o: WordOptions = WordOptions()) -> DataFrame:
    """extracted(doc_id, page_number, table_id, rows): null where a row has no cell in a column, '' where a cell is empty."""
    texts = cell_texts(chars, cells, o)
    by = [*PAGE, "table_id"]
    wide = texts.groupBy(*by).agg(F.max("col").alias("cols"), F.max("row").alias("rows"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "text"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), "rows"), lambda r: F.transform(F.sequence(F.lit(0), F.col("cols")), lambda c: F.element_at("m", F.struct(r.alias("row"), c.alias("col")))))
    return wide.select(*by, grid.alias("rows"))
