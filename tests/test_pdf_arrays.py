"""Characters of files as arrays: equal to those as rows, and used in the task that decodes them."""

import random

import numpy as np
import pytest
from test_pdf import one_page

from platen.plans import queries
from platen.sources import reader
from platen.sources.pdf import writer
from platen.sources.pdf.document import Document
from platen.sources.pdf.interpreter import clean, clean_all
from platen.sources.pdf.objects import Lexer

FONTS = b"""<< /ColorSpace << /C0 /DeviceCMYK >> /Font << /F1 9 0 R /F2 << /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding << /Differences [65 /fi /Lslash /nothing] >> >>
 /F3 << /Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.02 0 0] /FontBBox [0 -10 50 60] /FirstChar 64 /Widths [10 20 30.5] >>
 /F4 << /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [<< /DW 700 /W [1 [300 400]] >>] >>
 /F5 << /Type /Font /Subtype /Type0 /BaseFont /Down /Encoding /Identity-V /DescendantFonts [<< >>] >> >> >>"""


def contents():
    """Text by all operators, in random orders."""
    r = random.Random(17)
    number = lambda: b"%g" % r.choice([0, 1, -1, r.uniform(-3, 3), r.randrange(-40, 400) / 8])
    shown = lambda: writer.escape(bytes(r.choice(b"AB C@ fi()\\\xe9\x00\xff") for _ in range(r.randrange(0, 9))))
    steps = [
        lambda: b"/F%d %d Tf" % (r.randrange(1, 6), r.choice([0, 7, 10, -9])), lambda: shown() + b" Tj", lambda: shown() + b" Tj", lambda: shown() + b" Tj " + shown() + b" '", lambda: number() + b" TL T*",
        lambda: b"[" + shown() + b" " + number() + b" " + shown() + b"] TJ", lambda: number() + b" Tc", lambda: number() + b" Tw", lambda: b"%d Tz" % r.choice([100, 50, -80, 0]), lambda: number() + b" Ts",
        lambda: b"%s %s %s %s %s %s Tm" % tuple(number() for _ in range(6)), lambda: b"1 0 0 1 %s %s Tm" % (number(), number()), lambda: b"%s %s Td" % (number(), number()), lambda: b"q 1 0 0 -1 %s 9 cm" % number(), lambda: b"Q",
        lambda: b"0 1 -1 0 50 50 cm", lambda: b"/P << /MCID %d >> BDC" % r.randrange(3), lambda: b"EMC", lambda: b"0.5 g", lambda: b"/C0 cs 0 0 1 0 sc", lambda: b"1 2 " + shown() + b' "', lambda: b"ET BT", lambda: b"% (note) Tj\n",
    ]
    for _ in range(80):
        yield b"BT /F1 10 Tf 9 200 Td\n" + b"\n".join(r.choice(steps)() for _ in range(r.randrange(5, 60))) + b"\nET"


FILES = [one_page(c, FONTS, page=b"/Rotate %d" % (k % 4 * 90)) for k, c in enumerate(contents())]
FILES += [writer.text_pages("\n".join("a (b) \\c é" * (k % 5) for k in range(200))), writer.text_pages(""), b"nonsense", one_page(b"BT /F1 10 Tf (open"), one_page(b"BT /F9 1 Tf (no font) Tj /F1 1e12 Tf (far) Tj", FONTS)]


def rows_of(data, **options):
    found = list(reader.decode_file(1, "x", data, ("pages", "chars", "documents"), **options))
    chars = [r for kind, x in found if kind == "chars" for r in ([x] if isinstance(x, dict) else x.rows())]
    return [{k: v for k, v in c.items() if k not in ("doc_id", "seq")} for c in chars], [x for kind, x in found if kind != "chars"]


@pytest.mark.parametrize("norm", [None, "NFKD"])
def test_arrays_equal_rows(norm):
    n = 0
    for data in FILES:
        rows, others = rows_of(data, unicode_norm=norm)
        made, beside = rows_of(data, unicode_norm=norm, arrays=True)
        assert repr(made) == repr(rows) or made == rows
        assert beside == others
        n += len(rows)
    assert n > 5000


def test_runs_are_one():
    """Strings of one state and font come together, however many there are."""
    data = writer.text_pages("\n".join(["some text"] * 60))
    (_, objects), = Document(data, arrays=True).run()
    assert [len(g) for g in objects["chars"]] == [540]


def test_clean_of_all():
    r = random.Random(2)
    values = [r.uniform(-1e4, 1e4) for _ in range(5000)] + [k / 2**21 for k in range(-999, 999)] + [0.0000005, 1.0000015, -0.0, 1e13 + 0.3, 2.5e-6]
    assert list(map(repr, clean_all(np.array(values)).tolist())) == [repr(clean(v)) for v in values]


@pytest.mark.parametrize("data, expected", [(b"/ab#20c ", "ab c"), (b"/", ""), (b" -7 0", -7), (b"12.5", 12.5), (b"(a\\)b(c))", b"a)b(c)"), (b"(open", b"open"), (b"(a\\", b"a"), (b"(a(b", b"a(b"), (b"%x\n(a)", b"a"), (b"T*(a)", "T*"), (b"true", True)])
def test_usual_and_other_values(data, expected):
    got = Lexer(data).value(False)
    assert got == expected and type(got) in (type(expected), *type(expected).__subclasses__())


def test_no_row_for_each_character(spark):
    """A row for each character went from Python to Spark, which only counted them."""
    made = queries.queries()["s1_decode"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "kind#" not in plan


def test_files_of_one_id_and_broken_ones(spark):
    files = spark.createDataFrame([(1, "a", bytearray(writer.text_pages("ab\nc"))), (1, "b", bytearray(writer.text_pages("d"))), (2, "c", bytearray(b"nonsense")), (3, "d", None)], "doc_id long, path string, content binary")
    count = lambda decoded: (n,) if (n := sum(len(x) for kind, x in decoded if kind == "chars")) else None
    assert sorted(map(tuple, reader.decode_arrays(files, count, "doc_id long, n long").collect())) == [(1, 1), (1, 3)]
    with pytest.raises(Exception, match="InvalidPDFException"):
        reader.decode_arrays(files, count, "doc_id long, n long", mode="FAILFAST").collect()
