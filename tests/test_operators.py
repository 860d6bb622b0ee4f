"""Literal cases with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from platen.functions import geometry
from platen.operators import boxes, edges, layout, tables, text
from platen.operators.cluster import with_cluster
from platen.operators.words import WordOptions, extract_words

CHAR = "doc_id long, page_number int, seq long, text string, x0 double, x1 double, top double, bottom double, doctop double, width double, height double, size double, upright boolean, fontname string, y0 double, y1 double"


def chars(spark, items, top=0.0):
    """(text, x0, x1[, top[, upright]]) as characters of one page."""
    rows = []
    for i, (t, x0, x1, *more) in enumerate(items):
        at, upright = more[0] if more else top, more[1] if len(more) > 1 else True
        rows.append((0, 1, i, t, float(x0), float(x1), float(at), at + 10.0, float(at), float(x1) - x0, 10.0, 10.0, upright, "F", 0.0, 10.0))
    return spark.createDataFrame(rows, CHAR)


def texts(df, order="word_seq"):
    return [r.text for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("gap, expected", [(2.9, "ab"), (3.0, "ab"), (3.0 + 1e-9, "a b"), (3.25, "a b"), (-0.5, "ab"), (-6.5, "ba")])
def test_gaps_near_the_tolerance(spark, gap, expected):
    assert text.extract_text(chars(spark, [("a", 100.0, 106.0), ("b", 106.0 + gap, 112.0 + gap)])).first().text.replace(" ", "" if gap < 0 else " ") == expected


def test_right_to_left(spark):
    c = chars(spark, [("A", 50, 55), ("B", 45, 50), (" ", 42, 44), ("C", 37, 42), ("D", 32, 37)])
    assert texts(extract_words(c, WordOptions(horizontal_ltr=False))) == ["AB", "CD"]


@pytest.mark.parametrize("upright", [True, False])
def test_characters_of_no_size(spark, upright):
    c = chars(spark, [("A", 10, 10, 10.0, upright), (" ", 10, 10, 10.0, upright), ("B", 10, 10, 10.0, upright)]).withColumn("bottom", F.col("top"))
    assert sorted(texts(extract_words(c))) == ["A", "B"]


def test_cluster(spark):
    df = spark.createDataFrame([(0, 1, x) for x in (0.0, 2.0, 4.9, 9.0, 12.0, 12.0)], "doc_id long, page_number int, x double")
    assert [r.cluster for r in with_cluster(df, "x", 3.0).orderBy("x").collect()] == [0, 0, 0, 1, 1, 1]


def test_overlap_edge_counts_corner_does_not(spark):
    df = spark.createDataFrame([(10.0, 0.0, 20.0, 10.0), (10.0, 10.0, 20.0, 20.0)], "x0 double, top double, x1 double, bottom double")
    assert [r[0] for r in df.select(geometry.overlap((0, 0, 10, 10))).collect()] == [True, False]


def rects(spark, boxes_):
    rows = [(0, 1, i, "rect", *map(float, (x0, x1, t, b, t, x1 - x0, b - t)), None, False) for i, (x0, t, x1, b) in enumerate(boxes_)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, seq long, object_type string, x0 double, x1 double, top double, bottom double, doctop double, width double, height double, pts array<struct<x:double,y:double>>, closepath boolean")


def test_grid_is_one_table(spark):
    cells = tables.find_tables(rects(spark, [(x, y, x + 50, y + 20) for x in (0, 50) for y in (0, 20)]))
    assert cells.count() == 4
    placed = tables.with_axes(cells).collect()
    assert {(r.row, r.col) for r in placed} == {(0, 0), (0, 1), (1, 0), (1, 1)} and {r.table_id for r in placed} == {0}


def test_single_rectangle_is_no_table(spark):
    assert tables.find_tables(rects(spark, [(0, 0, 50, 20)])).count() == 0


def test_missing_cell_is_null_and_empty_cell_is_empty(spark):
    cells = tables.find_tables(rects(spark, [(0, 0, 50, 20), (50, 0, 100, 20), (0, 20, 50, 40)]))
    out = tables.extract_tables(chars(spark, [("x", 10, 16, 5.0)]), cells).first().rows
    assert out == [["x", ""], ["", None]]


def test_join_and_snap(spark):
    base = "doc_id long, page_number int, seq int, part int, orientation string, x0 double, x1 double, top double, bottom double"
    h = spark.createDataFrame([(0, 1, 0, 0, "h", 0.0, 10.0, 5.0, 5.0), (0, 1, 1, 0, "h", 12.0, 20.0, 5.0, 5.0)], base)
    assert [(r.x0, r.x1) for r in edges.join_edges(h).collect()] == [(0.0, 20.0)]
    v = spark.createDataFrame([(0, 1, i, 0, "v", x, x, 0.0, 9.0) for i, x in enumerate((10.0, 11.0, 13.0))], base)
    assert {r.x0 for r in edges.snap_edges(v).collect()} == {11.333333}


def test_doctop_roman_alpha(spark):
    pages = spark.createDataFrame([(0, 1, 792.0), (0, 2, 612.0), (0, 3, 792.0)], "doc_id long, page_number int, height double")
    assert [r.doctop_offset for r in boxes.doctop_offsets(pages).orderBy("page_number").collect()] == [0.0, 792.0, 1404.0]
    n = spark.createDataFrame([(1,), (4,), (9,), (27,), (3999,)], "n int")
    assert [r[0] for r in n.select(geometry.roman("n")).collect()] == ["i", "iv", "ix", "xxvii", "mmmcmxcix"]
    assert [r[0] for r in n.select(geometry.alpha("n")).collect()][:4] == ["a", "d", "i", "aa"]


def test_dedupe_keeps_first_and_is_idempotent(spark):
    c = chars(spark, [("A", 10, 16, 10.0), ("A", 10.3, 16.3, 10.3), ("B", 10, 16, 10.0)])
    once = boxes.dedupe(c)
    assert sorted((r.text, r.x0) for r in once.collect()) == [("A", 10.0), ("B", 10.0)]
    assert boxes.dedupe(once).count() == 2


def test_crop_again_changes_nothing_and_parts_cover(spark):
    c = chars(spark, [(str(k % 10), 6 * k, 6 * k + 6, 12.0 * (k // 5)) for k in range(20)])
    box = (9, 5, 60, 30)
    once = boxes.crop(c, box)
    assert sorted(once.collect()) == sorted(boxes.crop(once, box).collect())
    assert boxes.within(c, box).count() + boxes.outside(c, box).count() <= c.count() == once.count() + boxes.outside(c, box).count()


def test_checks():
    with pytest.raises(ValueError):
        boxes.check_box((5, 0, 1, 9))
    with pytest.raises(ValueError):
        boxes.check_box((0, 0, 20, 9), (0, 0, 10, 10))
    with pytest.raises(ValueError):
        WordOptions(line_dir="ttb", char_dir="btt")
    with pytest.raises(TypeError):
        tables.TableSettings.resolve(nonsense=1)
    with pytest.raises(ValueError):
        tables.TableSettings.resolve(vertical_strategy="explicit", explicit_vertical_lines=[1])
    with pytest.raises(ValueError):
        tables.TableSettings.resolve(snap_tolerance=-1)
    with pytest.raises(ValueError):
        text.TextOptions(layout=True, layout_width=9, layout_width_chars=3)


def test_settings():
    s = tables.TableSettings.resolve(snap_tolerance=2, join_x_tolerance=1, text_tolerance=4, text_y_tolerance=5)
    assert (s.snap_x_tolerance, s.snap_y_tolerance, s.join_x_tolerance, s.join_y_tolerance) == (2, 2, 1, 3)
    assert (s.text.x_tolerance, s.text.y_tolerance) == (4, 5)


def test_search_and_lines(spark):
    c = chars(spark, [("a", 0, 6), ("ﬁ", 6, 12), ("b", 20, 26), ("c", 0, 6, 20.0)])
    found = text.search(c, "f(i)", main_group=1).collect()
    assert [(r.text, r.x0, r.x1, r.groups) for r in found] == [("i", 6.0, 12.0, ["i"])]
    assert [(r.text, r.top) for r in text.extract_text_lines(c).orderBy("line_seq").collect()] == [("afi b", 0.0), ("c", 20.0)]
    assert text.search(c, "AF", case=False).count() == 1 and text.search(c, "a.", regex=False).count() == 0
    with pytest.raises(ValueError):
        text.search(c, re.compile("a"), regex=False)


def test_layout_grid(spark):
    c = chars(spark, [("a", 0, 6), ("b", 72.5, 78.5), ("c", 0, 6, 39.0)])
    o = text.TextOptions(layout=True, layout_width_chars=12, layout_height_chars=5, layout_bbox=(0, 0, 100, 100))
    assert text.extract_text(c, o).first().text == "\n".join(["a         b ", " " * 12, " " * 12, "c           "])


def test_render():
    assert text.render("ab\nc", "ttb", "rtl") == "ba\nc" and text.render("ab\nc", "btt", "ltr") == "c\nab"
    assert text.render("ab\nc", "ltr", "ttb") == "ac\nb "


def test_text_strategy_edges(spark):
    c = chars(spark, [(t, x, x + 6, 20.0 * r) for r in range(4) for x, t in ((0, "a"), (50, "b"))])
    words = extract_words(c)
    v = sorted(r.x0 for r in edges.words_to_edges_v(words, 3).collect())
    assert v == [0.0, 50.0, 56.0] and edges.words_to_edges_h(words).count() == 8


def area(*box):
    return layout.Area(*map(float, box))


def test_neighbours():
    line = area(10, 4, 20, 6)
    others = [area(10, 6, 15, 8), area(15, 2, 20, 4), area(13, 5, 17, 7), area(0, 6, 5, 8), area(10, 6, 15, 10)]
    assert layout.neighbours(line, [line, *others], 0.5) == [line, *others[:3]]
    a, b = area(1625.1993358296002, 52.93224, 1640.9641086296, 75.25224), area(1627.3696829148, 40.506119999999996, 1638.7563493148, 51.66611999999999)
    assert layout.neighbours(a, [a, b], 0.5) == [a]


def test_reading_order():
    page = [layout.Area(x, y, x + 90, y + 40, False, t) for x, y, t in ((0, 100, "a"), (0, 50, "b"), (200, 100, "c"), (200, 50, "d"))]
    assert [b.text for b in layout.order_boxes(page)] == ["a", "b", "c", "d"]
    assert [b.text for b in layout.order_boxes(page, layout.LayoutParams(boxes_flow=None))] == ["a", "c", "b", "d"]


def test_lines_of_any_length_keep_their_characters(spark, tmp_path):
    from platen.plans import bridge, queries

    text = "a" * 65_540 + "\nbc\n\nd"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.mcid: r.text for r in queries.queries()["a16_mcid_text"](spark, str(tmp_path)).collect()}
    assert got == {0: "P: " + "a" * 65_540, 1: "P: bc", 2: "", 3: "P: d"}
    chars = bridge.text_chars(bridge.table(spark, str(tmp_path), "documents")).orderBy("seq").select("text", "top").collect()
    assert "".join(c.text for c in chars) == text.replace("\n", "") and [c.top for c in chars] == sorted(c.top for c in chars)


def test_page_operators_on_dense_pages(spark):
    """Hundreds of boxes on one page, against plain loops."""
    import random

    r = random.Random(5)
    some = lambda n, size: [(0, 1, i, x := r.randrange(0, 4000) / 8, t := r.randrange(-800, 4000) / 8, x + r.randrange(0, size) / 8, t + r.randrange(0, size) / 8) for i in range(n)]
    schema = "doc_id long, page_number int, seq int, x0 double, top double, x1 double, bottom double"
    rows, others = some(400, 200), some(60, 900)
    overlaps = lambda a, b: (w := min(a[5], b[5]) - max(a[3], b[3])) >= 0 and (h := min(a[6], b[6]) - max(a[4], b[4])) >= 0 and w + h > 0
    df, by = spark.createDataFrame(rows, schema), spark.createDataFrame(others, schema)
    expected = {a[2] for a in rows if any(overlaps(a, b) for b in others)}
    assert {x.seq for x in boxes.within_any(df, by).collect()} == expected and 0 < len(expected) < 400
    assert {x.seq for x in boxes.within_any(df, by, False).collect()} == set(range(400)) - expected
    cells = by.withColumn("table_id", F.lit(0))
    held = {(a[2], b[3], b[4]) for a in rows for b in others if b[3] <= (a[3] + a[5]) / 2 < b[5] and b[4] <= (a[4] + a[6]) / 2 < b[6]}
    assert {(x.seq, x.c_x0, x.c_top) for x in tables.chars_in_cells(df, cells).collect()} == held


def test_lines_by_words_equal_lines_by_search(spark):
    c = chars(spark, [(t, 6.0 * i, 6.0 * i + 6, 12.0 * k) for k, line in enumerate(["one two ", "", " three", "fi ve  six"]) for i, t in enumerate(line)])
    found = text.search(c, re.compile(r" *([^\n]+?) *(?:\n|\Z)"), main_group=1).orderBy("match_seq").collect()
    lines = text.extract_text_lines(c, return_chars=True).orderBy("line_seq").collect()
    assert [(x.text, x.x0, x.top, x.x1, x.bottom) for x in lines] == [(x.text, x.x0, x.top, x.x1, x.bottom) for x in found]
    assert [x.text for x in lines] == ["one two", "three", "fi ve six"] and [len(x.char_seqs) for x in lines] == [6, 5, 7]


def plain_order(boxes_, flow):
    """Reading order by joining, each time, the closest pair that is left: a plain version with lists."""
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    around = lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
    nodes, tree, alive = dict(enumerate(boxes_)), {}, list(range(len(boxes_)))
    pairs = [(False, area(around(nodes[i], nodes[j])) - area(nodes[i]) - area(nodes[j]), i, j) for i in alive for j in alive if i < j]
    while pairs:
        late, far, i, j = pairs.pop(pairs.index(min(pairs)))
        if i not in alive or j not in alive:
            continue
        box = around(nodes[i], nodes[j])
        others = [k for k in alive if k not in (i, j)]
        if not late and any(nodes[k][2] >= box[0] and nodes[k][0] <= box[2] and nodes[k][3] >= box[1] and nodes[k][1] <= box[3] for k in others):
            pairs.append((True, far, i, j))
            continue
        new = len(nodes)
        nodes[new], tree[new], alive = box, (i, j), [*others, new]
        pairs += [(False, area(around(box, nodes[k])) - area(box) - area(nodes[k]), new, k) for k in others]

    def walk(k):
        if k not in tree:
            return [k]
        key = lambda n: (1 - flow) * nodes[n][0] - (1 + flow) * (nodes[n][1] + nodes[n][3])
        return [x for child in sorted(tree[k], key=key) for x in walk(child)]

    return walk(alive[0]) if alive else []


@pytest.mark.parametrize("seed", range(12))
def test_reading_order_equals_a_plain_version(seed):
    import random

    r = random.Random(seed)
    made = [(x := r.randrange(80) / 2, y := r.randrange(120) / 2, x + r.randrange(1, 30), y + r.randrange(1, 9)) for _ in range(r.randrange(1, 16))]
    flow = r.choice([-1.0, -0.3, 0.0, 0.5, 1.0])
    got = layout.order_boxes([layout.Area(*b, False, str(i)) for i, b in enumerate(made)], layout.LayoutParams(boxes_flow=flow))
    assert [int(b.text) for b in got] == plain_order(made, flow)


@pytest.mark.parametrize("seed", range(12))
def test_lines_and_boxes_equal_a_plain_version(seed):
    """Level text: a character joins the one before it if both overlap by half a height and are less than two widths
    apart; a line's box takes all lines near it, and those of their boxes so far."""
    import random

    r, p = random.Random(seed), layout.LayoutParams()
    glyphs, x, y = [], 0.0, 500.0
    for _ in range(80):
        x, y = (x + r.choice([5, 5, 5, 6, 9, 30]), y + r.choice([0, 0, 0, 1])) if r.random() < 0.85 else (float(r.randrange(0, 60)), y - r.choice([8, 11, 14, 40]))
        glyphs.append((x, y, x + 5, y + r.choice([9, 10]), r.choice("ab ")))
    runs, now = [], []
    for k, g in enumerate(glyphs):  # a character after a break is seen with its successor only
        if now:
            h = glyphs[k - 1]
            level = h[1] <= g[3] and g[1] <= h[3] and min(abs(h[1] - g[3]), abs(h[3] - g[1])) > 0.5 * min(h[3] - h[1], g[3] - g[1])
            far = 0.0 if h[0] <= g[2] and g[0] <= h[2] else min(abs(h[0] - g[2]), abs(h[2] - g[0]))
            if level and far < 2 * max(h[2] - h[0], g[2] - g[0]):
                now.append(g)
                continue
            runs.append(now)
        now = [g]
    runs.append(now)
    spaced = lambda run: "".join((" " if k and run[k - 1][2] < g[0] - 0.1 * max(g[2] - g[0], g[3] - g[1]) else "") + g[4] for k, g in enumerate(run)) + "\n"
    lines = layout.lines_of([layout.Area(*g[:4], False, g[4]) for g in glyphs], p)
    assert [x.text for x in lines] == [spaced(run) for run in runs]
    some = [x for x in lines if x.text.strip()]
    box = {}
    for i, a in enumerate(some):
        h, members = a.y1 - a.y0, {i: None}
        for j, b in enumerate(some):
            close = b.y0 <= a.y1 + h / 2 and b.y1 >= a.y0 - h / 2 and b.x0 <= a.x1 and b.x1 >= a.x0 and abs(b.y1 - b.y0 - h) <= h / 2
            if close and min(abs(b.x0 - a.x0), abs(b.x1 - a.x1), abs(b.x0 + b.x1 - a.x0 - a.x1) / 2) <= h / 2:
                members |= {j: None} | {k: None for k in box.get(j, ())}
        box |= dict.fromkeys(members, tuple(members))
    expected = []
    for i in range(len(some)):
        if box[i] not in expected:
            expected.append(box[i])
    assert [sorted(id(x) for x in b.parts) for b in layout.boxes_of(some, p)] == [sorted(id(some[k]) for k in m) for m in expected]


def test_wide_rows_are_deduplicated_like_narrow_ones(spark):
    import random

    r = random.Random(4)
    c = chars(spark, [(r.choice("ab"), x := r.randrange(0, 400) / 10, x + 5, r.randrange(0, 30) / 10) for _ in range(300)])
    wide = c.withColumns({f"more_{k}": F.lit(k) for k in range(boxes.NARROW)})
    few, many = boxes.dedupe(c), boxes.dedupe(wide)
    assert sorted(x.seq for x in few.collect()) == sorted(x.seq for x in many.collect()) and 10 < few.count() < 200 and many.columns == wide.columns


def test_the_largest_table_is_found_in_one_pass(spark):
    """Ties of size go to the highest and then the leftmost, as largest_table has it."""
    from platen.plans import queries

    grid = lambda x, y, n: [(x + 50 * i, y, x + 50 * i + 50, y + 20) for i in range(n)]
    for boxes_ in (grid(0, 0, 2) + grid(0, 100, 3), grid(300, 0, 2) + grid(0, 0, 2), grid(0, 100, 2) + grid(300, 0, 2), grid(0, 0, 1)):
        page = rects(spark, boxes_)
        assert sorted(tables.find_tables(page, largest=True).collect()) == sorted(tables.largest_table(tables.find_tables(page)).collect())
    plan = queries.queries()["a10_largest_of_many"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "LeftSemi" not in plan
