"""Tables of whole pages as arrays: edges of rectangles, cells and cell texts of many pages at once, as ``tables`` finds
them page by page and row by row."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from .bulk import Block, _line_key, clean, cluster, table, take, words
from .tables import TableSettings, find_cells, group_cells
from .words import WordOptions

#: Pairs of upright and level edges that are looked at at once, and of one page, beyond which it is worked through alone.
PAIRS, MOST = 1 << 20, 1 << 23
EXTRACTED = "doc_id long, page_number int, table_id int, rows array<array<string>>"


def merge_edges(page: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, snap: float, join: float) -> tuple[np.ndarray, ...]:
    """Snapped and joined edges of one direction: page, place, start and end, in this order."""
    if not len(page):
        return page, at, low, high
    group = None
    if snap > 0:
        group = cluster(page, at, snap)
        by = (np.bincount(group, at) / np.bincount(group))[group] - at
        at, group = (clean(at + by), None) if by.any() else (at, group)
    if group is None:
        group = cluster(page, at, 0.0)
    codes, values = pd.factorize(low)
    order = np.argsort(values)
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.arange(len(values))
    order = np.argsort(group * len(values) + rank[codes])
    group, low, high = group[order], low[order], high[order]
    same = group[1:] == group[:-1]
    reach = high if ((high[1:] >= high[:-1]) | ~same).all() else pd.Series(high).groupby(group).cummax().to_numpy()
    first = np.flatnonzero(np.concatenate([[True], ~same | (low[1:] > reach[:-1] + join)]))
    rows = order[first]
    return page[rows], at[rows], low[first], np.maximum.reduceat(high, first)


def rect_edges(b: Block, s: TableSettings = TableSettings()) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Upright and level edges of rectangles, merged and filtered by length."""
    if (s.vertical_strategy, s.horizontal_strategy) != ("lines", "lines") or s.explicit_vertical_lines or s.explicit_horizontal_lines:
        raise ValueError("edges in bulk are those of rectangles only")
    c = {k: clean(b[k]) for k in ("x0", "x1", "top", "bottom")}
    sides = {"v": (c["x0"], c["x1"], c["top"], c["bottom"], b["height"]), "h": (c["top"], clean(b["top"] + b["height"]), c["x0"], c["x1"], b["width"])}
    out = []
    for way, snap, join in (("v", s.snap_x_tolerance, s.join_y_tolerance), ("h", s.snap_y_tolerance, s.join_x_tolerance)):
        one, other, low, high, length = sides[way]
        page, keep = b.page, clean(np.broadcast_to(length, len(b))) >= s.edge_min_length_prefilter
        if not keep.all():
            page, one, other, low, high = (v[keep] for v in (page, one, other, low, high))
        # a page's edges stay together, so that clusters are found in order
        pair = lambda p, q: np.stack([p, q], axis=1).ravel()
        made = merge_edges(np.repeat(page, 2), pair(one, other), np.repeat(low, 2), np.repeat(high, 2), snap, join)
        long = clean(made[3] - made[2]) >= s.edge_min_length
        out.append(made if long.all() else tuple(v[long] for v in made))
    return out[0], out[1]


def _numbered(page: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the places on their pages; rows are in order."""
    return np.cumsum(np.concatenate([[True], (page[1:] != page[:-1]) | (at[1:] != at[:-1])])[: len(page)]) - 1


def _groups(corners: tuple[np.ndarray, ...], points: int) -> np.ndarray:
    """For each cell the first one that it is joined with by shared corners, directly or through others."""
    n = len(corners[0])
    label = np.arange(n)
    while True:
        least = np.full(points, n)
        for c in corners:
            np.minimum.at(least, c, label)
        new = label
        for c in corners:
            new = np.minimum(new, least[c])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cells(v: tuple[np.ndarray, ...], h: tuple[np.ndarray, ...], x_tolerance: float, y_tolerance: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Page, table, x0, top, x1 and bottom of the cells of some pages, and the pages where edges of one line meet another at
    the same point, which are left out."""
    (vp, vx, vt, vb), (hp, hy, hl, hr) = v, h
    pages = int(vp.max()) + 1 if len(vp) else 0
    many = np.bincount(hp, minlength=pages)
    at = np.cumsum(many) - many
    per = many[vp]
    base = np.cumsum(per) - per  # of each upright's pairs
    i = np.repeat(np.arange(len(vp)), per)
    j = np.arange(len(i)) + np.repeat(at[vp] - base, per)
    x, y = vx[i], hy[j]
    met = (y >= (vt - y_tolerance)[i]) & (y <= (vb + y_tolerance)[i]) & ((hl - x_tolerance)[j] <= x) & (x <= (hr + x_tolerance)[j])
    found = np.flatnonzero(met)
    i, j = i[found], j[found]
    column, row = _numbered(vp, vx), _numbered(hp, hy)
    odd = np.zeros(0, dtype=np.int64)
    if len(vp) > column[-1] + 1 or len(hp) > row[-1] + 1:
        key = column[i] * (row[-1] + 1) + row[j]
        order = np.argsort(key)
        twice = order[1:][key[order[1:]] == key[order[:-1]]]
        if len(twice):
            odd = np.unique(vp[i[twice]])
            keep = ~np.isin(vp[i], odd)
            met[found[~keep]] = False
            found, i, j = found[keep], i[keep], j[keep]
    n = len(found)
    place = np.full(len(met), -1)
    place[found] = np.arange(n)

    def following(order, line):
        """The next point of the same line."""
        out = np.full(n, -1)
        same = line[order[1:]] == line[order[:-1]]
        out[order[:-1][same]] = order[1:][same]
        return out

    every = np.arange(n)
    below, beside = following(every, i), following(np.argsort(j * len(vp) + i), j)
    mine = every[(below >= 0) & (beside >= 0)]
    down, right = below[mine], beside[mine]
    cells = []
    while len(mine):
        u, w = i[right], j[down]
        across = place[base[u] + w - at[vp[u]]]
        hit = across >= 0
        cells.append((mine[hit], right[hit], down[hit], across[hit]))
        mine, down, right = mine[~hit], down[~hit], beside[right[~hit]]
        over = right < 0  # no more to the right: the next below, from the first again
        down[over] = below[down[over]]
        right[over] = beside[mine[over]]
        mine, down, right = (a[down >= 0] for a in (mine, down, right))
    a, r, d, z = (np.concatenate(c) for c in zip(*cells)) if cells else (np.zeros(0, dtype=np.int64),) * 4
    order = np.argsort(row[j[a]] * (column[-1] + 1 if len(column) else 1) + column[i[a]])  # by page, from top to bottom, left to right
    a, r, d, z = a[order], r[order], d[order], z[order]
    if not len(a):
        return [a, a, *(np.zeros(0) for _ in range(4))], odd
    first = _groups((a, r, d, z), n)
    size = np.bincount(first, minlength=len(a))
    page = vp[i[a]]
    heads = np.flatnonzero(size > 1)
    number = np.zeros(len(a), dtype=np.int64)
    number[heads] = np.arange(len(heads)) - np.searchsorted(page[heads], page[heads], "left")
    keep = size[first] > 1
    a, r, d, first = a[keep], r[keep], d[keep], first[keep]
    return [page[keep], number[first], vx[i[a]], hy[j[a]], vx[i[r]], hy[j[d]]], odd


def find_tables(b: Block, s: TableSettings = TableSettings()) -> Block:
    """Cells of the tables of pages of rectangles: table_id, row, col and sides, in this order by page."""
    v, h = rect_edges(b, s)
    tolerances = s.intersection_x_tolerance, s.intersection_y_tolerance
    n = len(b.keys[0])
    pairs = np.bincount(v[0], minlength=n) * np.bincount(h[0], minlength=n)
    some, alone = np.flatnonzero((pairs > 0) & (pairs <= MOST)), np.flatnonzero(pairs > MOST).tolist()
    ends, made, k = np.cumsum(pairs[some]), [], 0
    while k < len(some):
        last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        here = [slice(*np.searchsorted(e[0], (some[k], some[last - 1] + 1))) for e in (v, h)]
        parts = [tuple(c[at] for c in e) for e, at in zip((v, h), here)]
        if some[last - 1] - some[k] >= last - k:  # other pages lie between
            parts = [tuple(c[np.isin(e[0], some[k:last])] for c in e) for e in parts]
        parts = [(e[0] - some[k], *e[1:]) for e in parts]
        cells, odd = _cells(*parts, *tolerances)
        cells[0] = cells[0] + some[k]
        made.append(cells)
        alone += (odd + some[k]).tolist()
        k = last
    for p in alone:
        up, level = (slice(*np.searchsorted(e[0], (p, p + 1))) for e in (v, h))
        edges = [(1.0, x, x, t, u) for x, t, u in zip(*(c[up] for c in v[1:]))] + [(0.0, x, y, t, t) for t, x, y in zip(*(c[level] for c in h[1:]))]
        rows = list(chain.from_iterable([(p, t, *c) for c in g] for t, g in enumerate(group_cells(find_cells(np.array(edges), *tolerances)))))
        if rows:
            made.append([np.array(c) for c in zip(*rows)])
    page, number, *sides = (np.concatenate(c) for c in zip(*made)) if made else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),) * 4
    of = page * (int(number.max()) + 1 if len(number) else 1) + number

    def axis(values):
        k = cluster(of, values, 0.0)
        least = np.full(int(of.max()) + 1, len(k))
        np.minimum.at(least, of, k)
        return k - least[of]

    row, col = (axis(sides[k]) for k in (1, 0)) if len(of) else (of, of)
    order = np.lexsort((col, row, of))
    columns = dict(zip(("table_id", "row", "col", "x0", "top", "x1", "bottom"), (number, row, col, *sides)))
    return Block(b.keys, page[order], {k: c[order] for k, c in columns.items()})


def in_cells(chars: Block, cells: Block) -> tuple[np.ndarray, np.ndarray]:
    """Characters and the cells that hold their middles, by the cells that touch the square of a grid that a middle is in."""
    none = np.zeros(0, dtype=np.int64)
    if not len(chars) or not len(cells):
        return none, none
    middle = [(chars[p] + chars[q]) / 2 for p, q in (("x0", "x1"), ("top", "bottom"))]
    low, high = [cells["x0"], cells["top"]], [cells["x1"], cells["bottom"]]
    side = [max(1.0, float(np.median(q - p))) for p, q in zip(low, high)]
    while True:
        first = [np.floor(p / w).astype(np.int64) for p, w in zip(low, side)]
        span = [np.maximum(np.floor(np.nextafter(q, -np.inf) / w).astype(np.int64) - f + 1, 0) for q, w, f in zip(high, side, first)]
        start = [int(f.min()) for f in first]
        size = [int((f + n).max()) - a + 1 for f, n, a in zip(first, span, start)]
        if (span[0] * span[1]).sum() <= 4 * len(cells) + 1000 and len(chars.keys[0]) * size[0] * size[1] < 2**62:
            break
        side = [2 * w for w in side]
    n = span[0] * span[1]
    of = np.repeat(np.arange(len(cells)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    key = (cells.page[of] * size[1] + first[1][of] - start[1] + k // span[0][of]) * size[0] + first[0][of] - start[0] + k % span[0][of]
    order = np.argsort(key, kind="stable")
    of, key = of[order], key[order]
    on = [np.floor(m / w) - a for m, w, a in zip(middle, side, start)]
    inside = (on[0] >= 0) & (on[0] < size[0]) & (on[1] >= 0) & (on[1] < size[1]) & chars.known()[chars.page]
    rows = np.arange(len(chars)) if inside.all() else np.flatnonzero(inside)
    at = (chars.page[rows] * size[1] + on[1][rows].astype(np.int64)) * size[0] + on[0][rows].astype(np.int64)
    wide = len(chars.keys[0]) * size[0] * size[1]
    if wide <= 8 * len(chars) + 1_000_000:
        held = np.bincount(key, minlength=wide)
        begin, many = (np.cumsum(held) - held)[at], held[at]
    else:
        begin = np.searchsorted(key, at, "left")
        many = np.searchsorted(key, at, "right") - begin
    if (many == 1).all():
        cell = of[begin]
    else:
        rows, cell = np.repeat(rows, many), of[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]
    x, y = (m[rows] for m in middle)
    keep = (x >= cells["x0"][cell]) & (x < cells["x1"][cell]) & (y >= cells["top"][cell]) & (y < cells["bottom"][cell])
    return (rows, cell) if keep.all() else (rows[keep], cell[keep])


def cell_texts(chars: Block, cells: Block, o: WordOptions = WordOptions()) -> tuple[bytes, np.ndarray]:
    """The texts of all cells behind each other in UTF-8, and the length of each cell's."""
    lengths = np.zeros(len(cells), dtype=np.int64)
    rows, cell = in_cells(chars, cells)
    if not len(rows):
        return b"", lengths
    if (cell[1:] < cell[:-1]).any():
        order = np.argsort(cell, kind="stable")
        rows, cell = rows[order], cell[order]
    names = ("x0", "x1", "top", "bottom", "height", "width", "size", "upright", "code", "seq", *o.extra_attrs)
    # each cell is a page of its own
    w = words(Block([cells.page], cell, {k: take(chars[k], rows) for k in names if k in chars.columns}), o)
    if not len(w):
        return b"", lengths
    line = cluster(w.page, _line_key(w.sides, o.line_dir), float(o.y_tolerance))
    if (line[1:] >= line[:-1]).all():
        whole, _, ends = w.joined(np.where(w.breaks, np.uint32(10), np.uint32(32)))
        held = w.page[w.opens]
        data = whole.encode()
        if len(data) > len(whole):
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            ends = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))[ends]
        lengths[held] = np.diff(ends)
        return data, lengths
    texts, last, out = w.text, None, [""] * len(cells)  # words of one line that don't follow each other
    for k in np.argsort(line, kind="stable").tolist():
        p = int(w.page[k])
        out[p] += (" " if last == line[k] else "\n" if out[p] else "") + texts[k]
        last = line[k]
    raw = [t.encode() for t in out]
    return b"".join(raw), np.array([len(t) for t in raw], dtype=np.int64)


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(n)), pa.int32())


def extract_tables(cells: Block, chars: Block, o: WordOptions = WordOptions()) -> pa.RecordBatch:
    """Tables with their rows of texts, as ``tables.extract_tables`` has them."""
    data, lengths = cell_texts(chars, cells, o)
    page, number = cells.page, cells["table_id"]
    opens = np.concatenate([[True], (page[1:] != page[:-1]) | (number[1:] != number[:-1])])[: len(cells)]
    first, of = np.flatnonzero(opens), np.cumsum(opens) - 1
    most = lambda c: np.maximum.reduceat(cells[c], first) + 1 if len(first) else first
    high, wide = most("row"), most("col")
    slots = high * wide
    slot = (np.cumsum(slots) - slots)[of] + cells["row"] * wide[of] + cells["col"]
    n = np.zeros(int(slots.sum()), dtype=np.int64)
    n[slot] = lengths
    there = np.zeros(len(n), dtype=bool)
    there[slot] = True
    offsets = np.append(0, np.cumsum(n)).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data), pa.py_buffer(np.packbits(there, bitorder="little")))
    lines = pa.ListArray.from_arrays(_offsets(np.repeat(wide, high)), texts)
    keys = [k.take(pa.array(page[first])) for k in cells.keys]
    return table(["doc_id", "page_number", "table_id", "rows"], [*keys, pa.array(number[first], pa.int32()), pa.ListArray.from_arrays(_offsets(high), lines)])
