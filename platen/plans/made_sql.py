"""The expected rows of ``made_files`` in DuckDB SQL."""

from __future__ import annotations

_N = "(SELECT s_suppkey AS doc_id, s_suppkey AS k, s_nationkey::DOUBLE AS n, s_name AS name FROM supplier)"
_RECT = f"SELECT doc_id, 0::BIGINT AS seq, n AS x0, 280 - n AS top, n + 60 AS x1, 300 - n AS bottom FROM {_N}"


def _rows(columns: str, *rows: str) -> str:
    """One row of each kind for each supplier; expressions may use n, k and name."""
    names = columns.split(", ")
    return " UNION ALL ".join(f"SELECT doc_id, {i}::BIGINT AS seq, " + ", ".join(f"{v} AS {c}" for c, v in zip(names, row.split("; "))) + f" FROM {_N}" for i, row in enumerate(rows))


#: x0; top; x1; bottom of boxes in page coordinates from raw ones, on a page 300 high.
def _raw(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"({x0})::DOUBLE; (300 - ({y1}))::DOUBLE; ({x1})::DOUBLE; (300 - ({y0}))::DOUBLE"


_BOX = "x0, top, x1, bottom"
#: Courier: descent 0.194 of the size, boxes as high as the size.
_GLYPHS = """SELECT doc_id, i::BIGINT AS seq, 20 + n + 6 * i::DOUBLE AS x0, 300 - 250 + 1.94 - 10 AS top, 26 + n + 6 * i::DOUBLE AS x1, 300 - 250 + 1.94 AS bottom,
  name[i + 1] AS text, 10.0 AS size, true AS upright, 'Courier' AS fontname FROM (SELECT *, unnest(range(length(name))) AS i FROM """


def _text(*glyphs: tuple) -> str:
    """Characters of a text of size 10 at raw (x, y) with a descent and an advance."""
    return _rows(f"{_BOX}, text", *(_raw(f"{x}", f"{y} + 10 * ({d})", f"{x} + {w}", f"{y} + 10 * ({d} + 1)") + f"; {t}" for x, y, d, w, t in glyphs))


def _paint(op: str) -> str:
    return f"{str(op[0] in 'SsBb').lower()}; {str(op[0] in 'fFBb').lower()}; {str(op.endswith('*')).lower()}"


MADE = {
    "s3_pages": "SELECT s_suppkey AS doc_id, unnest([2, 3])::BIGINT AS page_number, unnest(['ii', 'p-' || s_suppkey]) AS label, unnest([300.0, 600.0]) AS doctop_offset FROM supplier",
    "s5_object_streams": f"SELECT doc_id, name AS title, n AS x0 FROM {_N}",
    "s8_tolerant_content": _RECT,
    "s9_filters": f"{_RECT} UNION ALL SELECT doc_id, 1, n + 1, 279 - n, n + 61, 299 - n FROM {_N}",
    "s10_predictors": _RECT,
    "s12_contents": _RECT,
    "s13_inherited": f"SELECT doc_id, name AS text, CASE WHEN k % 2 = 0 THEN 200 + n ELSE 300 END AS width, CASE WHEN k % 2 = 0 THEN 300 ELSE 200 + n END AS height, (90 * (k % 4))::BIGINT AS rotate FROM {_N}",
    "s18_char_boxes": _GLYPHS + _N + ")",
    # half as wide; a space adds 4, every character 1.5, before scaling
    "s16_text_state": _text(("n", "253", "-0.194", "3", "'a'"), ("n + 3.75", "253", "-0.194", "3", "' '"), ("n + 9.5", "253", "-0.194", "3", "'b'"), ("n + 13.25", "253", "-0.194", "3", "'c'"), ("n + 18", "253", "-0.194", "3", "'d'"), ("n", "241", "-0.194", "3", "'e'"), ("n", "229", "-0.194", "3", "'f'")),
    "s16_rotated_text": _rows(f"{_BOX}, text, upright, size", *(_raw("91.94", f"n + {50 + 6 * i}", "101.94", f"n + {56 + 6 * i}") + f"; '{c}'; false; 10.0" for i, c in enumerate("abc"))),
    "s19_paths": _rows(f"{_BOX}, object_type, n_pts", *(_raw(*box) + f"; '{kind}'; {n}::BIGINT" for kind, n, box in (
        ("rect", 4, ("n", "10", "n + 20", "40")), ("rect", 4, ("n", "50", "n + 20", "70")), ("line", 2, ("n", "90", "n + 20", "95")), ("line", 2, ("n", "100", "n + 10", "110")),
        ("line", 2, ("n + 10", "100", "n + 20", "110")), ("curve", 3, ("n", "120", "n + 20", "140")), ("curve", 2, ("n", "150", "n + 30", "170")),
    ))),
    "f13_paint": _rows(f"{_BOX}, stroke, fill, evenodd", *(_raw("n", f"{10 * k}", "n + 60", f"{10 * k + 20}") + "; " + _paint(op) for k, op in enumerate(("S", "s", "f", "F", "f*", "B", "B*", "b", "b*")))),
    "f2_matrices": _rows(_BOX, _raw("2 * n + 10", "3 * n + 20", "2 * n + 30", "3 * n + 50"), _raw("86", "20", "90", "35"), _raw("n", "0", "n + 5", "5")),
    "f5_colours": _rows(f"{_BOX}, n, total, stroked, linewidth", *(_raw("0", f"{10 * k}", "9", f"{10 * k + 9}") + f"; {n}::BIGINT; {total}; {stroked}; 0.0" for k, (n, total, stroked) in enumerate(((1, "0.5::DOUBLE", "0.25::DOUBLE"), (3, "1.5::DOUBLE", "NULL"), (4, "1.25::DOUBLE", "NULL"), *[(3, "round(0.3 + (n + 10) / 100, 6)", "NULL")] * 2)))),
    "s20_images": _rows(f"{_BOX}, name, w, h, imagemask, colorspace", _raw("10", "20", "40 + n", "60") + "; 'Im'; 4 + n; 3.0; false; 'DeviceGray'", _raw("n + 1", "51", "n + 11", "61") + "; 'Im'; 4 + n; 3.0; false; 'DeviceGray'", _raw("0", "0", "8", "8") + "; 'inline'; 2.0; 2.0; true; NULL"),
    "s22_marked_content": f"SELECT doc_id, unnest(['a', 'b', 'c', 'd']) AS text, unnest([n::BIGINT, n::BIGINT, -1, 99]) AS mcid, unnest(['P', 'P', '', 'H1']) AS tag FROM {_N}",
    "s23_type0": _text(("10", "10", "-0.2", "5", "chr((65 + n)::INT)"), ("15", "10", "-0.2", "2.5", "'a'"), ("17.5", "10", "-0.2", "2.5", "'c'"), ("20", "10", "-0.2", "7", "'fi'"), ("27", "10", "-0.2", "7", "'(cid:153)'")),
    "s24_differences": _text(("10", "10", "-0.3", "5", "'é'"), ("15", "10", "-0.3", "6", "'Ж'"), ("21", "10", "-0.3", "7 + n / 100", "'€'"), ("28 + n / 100", "10", "-0.3", "4", "'a'"), ("32 + n / 100", "10", "-0.3", "4", "'d'")),
    "s25_standard_widths": " UNION ALL ".join(f"SELECT * FROM ({q}) WHERE doc_id % 2 = {odd}" for odd, q in ((1, _text(("n", "10", "-0.207", "9.44", "'W'"), ("n + 9.44", "10", "-0.207", "2.22", "'i'"), ("n + 11.66", "10", "-0.207", "2.78", "'.'"))), (0, _text(("n", "10", "-0.217", "9.44", "'W'"), ("n + 9.44", "10", "-0.217", "2.78", "'i'"), ("n + 12.22", "10", "-0.217", "2.5", "'.'"))))),
    "s29_page_boxes": """SELECT s_suppkey AS doc_id, [200.0, 300.0][t % 2 + 1] AS width, [300.0, 200.0][t % 2 + 1] AS height, 0.0 AS bbox_x0, 0.0 AS bbox_top, [200.0, 300.0][t % 2 + 1] AS bbox_x1, [300.0, 200.0][t % 2 + 1] AS bbox_bottom,
  [10.0, 20.0, 50.0, 50.0][t + 1] AS cropbox_x0, [50.0, 10.0, 20.0, 50.0][t + 1] AS cropbox_top, [150.0, 250.0, 190.0, 280.0][t + 1] AS cropbox_x1, [280.0, 150.0, 250.0, 190.0][t + 1] AS cropbox_bottom FROM (SELECT *, s_suppkey % 4 AS t FROM supplier)""",
    "s31_errors": f"SELECT doc_id, [NULL, 'InvalidPDFException', 'PageError'][k % 3 + 1] AS error, [1, 0, 1][k % 3 + 1]::BIGINT AS page_count, [1, 0, 0][k % 3 + 1]::BIGINT AS n FROM {_N}",
    "s34_objects": f"SELECT doc_id, unnest(['rect', 'line', 'annot']) AS object_type, 1::BIGINT AS n, unnest([n, 10.0, 10.0]) AS x0 FROM {_N}",
    "f10_strings": f"SELECT doc_id, name || 'é€' AS title, name AS author FROM {_N}",
    "f11_normal_forms": f"SELECT doc_id, unnest([0, 1])::BIGINT AS seq, unnest(['fi', chr((65 + n)::INT)]) AS text FROM {_N}",
    "p12_hyperlinks": f"SELECT doc_id, 3::BIGINT AS n, name AS contents, 'someone' AS title, n + 11 AS x0, 2::BIGINT AS links, 'http://b' AS last FROM {_N}",
}
