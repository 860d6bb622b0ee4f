"""Queries on small PDF files, one feature each, made from the rows of ``supplier``. Their expected rows follow from the
construction; the SQL is in ``made_sql``."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..pageset import PageSet
from ..sources import reader
from ..sources.pdf import writer
from . import bridge
from .queries import _query

COURIER = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"
FONTS = b"/Font << /F1 9 0 R >>"


def one_page(content: bytes | dict[int, bytes], resources: bytes = FONTS, entries: bytes = b"", more: dict[int, bytes] | None = None, extra: bytes = b"", parent: bytes = b"", box: bytes = b"/MediaBox [0 0 200 300]") -> bytes:
    """A file of one page; ``content`` is its stream's bytes, or streams by their object numbers."""
    streams = {4: writer.stream(content)} if isinstance(content, bytes) else content
    refs = b" ".join(b"%d 0 R" % n for n in streams)
    return writer.build({
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] %s >>" % parent,
        3: b"<< /Type /Page /Parent 2 0 R %s %s /Contents [%s] %s >>" % (box, b"/Resources << %s >>" % resources if resources else b"", refs, entries),
        9: COURIER, **streams, **(more or {}),
    }, extra=extra)


def _files(spark, sf_dir, build: Callable[[int, str, int], bytes]) -> DataFrame:
    """(doc_id, path, content): a file for each supplier, from its key, name and nation."""

    @F.pandas_udf("binary")
    def made(keys: pd.Series, names: pd.Series, nations: pd.Series) -> pd.Series:
        return pd.Series([build(int(k), s, int(n)) for k, s, n in zip(keys, names, nations)], dtype=object)

    suppliers = bridge.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").repartition(max(8, spark.sparkContext.defaultParallelism), "s_suppkey")
    return suppliers.select(F.col("s_suppkey").cast("long").alias("doc_id"), F.lit("made").alias("path"), made("s_suppkey", "s_name", "s_nationkey").alias("content"))


def _boxes(spark, sf_dir, build, kind: str = "vectors", *more) -> DataFrame:
    return reader.decode(_files(spark, sf_dir, build), kind).select("doc_id", F.col("seq").cast("long").alias("seq"), "x0", "top", "x1", "bottom", *more)


def rect(n: int) -> bytes:
    return b"%d %d 60 20 re f" % (n, n)


@_query
def s3_pages(spark, sf_dir):
    from .decoding import _reports

    return reader.decode(_reports(spark, sf_dir), "pages", pages=[2, 3]).select("doc_id", F.col("page_number").cast("long").alias("page_number"), "label", "doctop_offset")


@_query
def s5_object_streams(spark, sf_dir):
    def build(key, name, nation):
        inner = {3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 300] /Contents 4 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", 8: b"<< /Title %s >>" % writer.escape(name.encode())}
        heads, body = b"", b""
        for number, text in inner.items():
            heads, body = heads + b"%d %d " % (number, len(body)), body + text + b" "
        packed = writer.stream(heads + body, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(heads)), compress=True)
        return writer.build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: writer.stream(rect(nation)), 7: packed}, extra=b"/Info 8 0 R")

    made = reader.decode_kinds(_files(spark, sf_dir, build), ("documents", "vectors"))
    key = F.coalesce("documents.doc_id", "vectors.doc_id").alias("doc_id")
    return made.groupBy(key).agg(F.max(F.col("documents.metadata")["Title"]).alias("title"), F.max("vectors.x0").alias("x0"))


@_query
def s8_tolerant_content(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"1 2 foo [1 (re f) /x 3] bar % 9 9 9 9 re f\n<< /A (S) /B [<</C 1>>] >> baz (1 1 5 5 re \\( f) qux 7 " + rect(nation) + b" ] >> 3 Q Q unknown")

    return _boxes(spark, sf_dir, build)


def _run_length(data: bytes) -> bytes:
    parts = [data[i : i + 100] for i in range(0, len(data), 100)]
    return b"".join(bytes([len(p) - 1]) + p for p in parts) + b"\x80"


@_query
def s9_filters(spark, sf_dir):
    def build(key, name, nation):
        data = rect(nation) + b" " + b"%" + b" " * 300 + b"\n" + rect(nation + 1)
        a85 = lambda x: base64.a85encode(x) + b"~>"
        made, names = [
            (zlib.compress(data), b"/FlateDecode"), (a85(data), b"/A85"), (data.hex().encode() + b">", b"[/ASCIIHexDecode]"),
            (_run_length(data), b"/RunLengthDecode"), (a85(zlib.compress(data)), b"[/ASCII85Decode /FlateDecode]"),
        ][key % 5]
        return one_page({4: writer.stream(made, b"/Filter %s" % names)})

    return _boxes(spark, sf_dir, build)


@_query
def s10_predictors(spark, sf_dir):
    def build(key, name, nation):
        data, columns, rows, before = rect(nation), 5, b"", bytes(5)
        data += b" " * (-len(data) % columns)
        for at in range(0, len(data), columns):
            row, kind = data[at : at + columns], (key + at) % 5
            out = bytearray([kind])
            for i, c in enumerate(row):
                left, up, corner = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
                guess = left + up - corner
                paeth = min((left, up, corner), key=lambda v: abs(guess - v))
                out.append((c - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
            rows, before = rows + bytes(out), row
        return one_page({4: writer.stream(zlib.compress(rows), b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns %d >>" % columns)})

    return _boxes(spark, sf_dir, build)


@_query
def s12_contents(spark, sf_dir):
    def build(key, name, nation):
        return one_page({4: writer.stream(b"%d %d" % (nation, nation)), 5: writer.stream(b"60 20 re", compress=True), 6: writer.stream(b"f")})

    return _boxes(spark, sf_dir, build)


@_query
def s13_inherited(spark, sf_dir):
    def build(key, name, nation):
        shown = b"BT /F1 10 Tf 10 10 Td %s Tj ET" % writer.escape(name.encode())
        return one_page(shown, b"", parent=b"/Resources << %s >> /MediaBox [0 0 %d 300] /Rotate %d" % (FONTS, 200 + nation, 90 * (key % 4)), box=b"")

    made = reader.decode_kinds(_files(spark, sf_dir, build), ("pages", "chars"))
    key = F.coalesce("pages.doc_id", "chars.doc_id").alias("doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "chars", F.struct("chars.seq", "chars.text")))), lambda c: c["text"]), "")
    return made.groupBy(key).agg(text.alias("text"), F.max("pages.width").alias("width"), F.max("pages.height").alias("height"), F.max(F.col("pages.rotate").cast("long")).alias("rotate"))


@_query
def s18_char_boxes(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"BT /F1 10 Tf %d 250 Td %s Tj ET" % (20 + nation, writer.escape(name.encode())))

    return _boxes(spark, sf_dir, build, "chars", "text", "size", "upright", "fontname")


@_query
def s16_text_state(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"BT /F1 10 Tf 1.5 Tc 4 Tw 50 Tz 3 Ts %d 250 Td (a b) Tj [(c) -200 (d)] TJ 12 TL T* (e) Tj (f) ' ET" % nation)

    return _boxes(spark, sf_dir, build, "chars", "text")


@_query
def s16_rotated_text(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"BT /F1 10 Tf 0 1 -1 0 100 %d Tm (abc) Tj ET" % (50 + nation))

    return _boxes(spark, sf_dir, build, "chars", "text", "upright", "size")


@_query
def s19_paths(spark, sf_dir):
    def build(key, name, nation):
        n = nation
        return one_page(b"%d 10 20 30 re S %d 50 m %d 50 l %d 70 l %d 70 l h f " % (n, n, n + 20, n + 20, n) + b"%d 90 m %d 95 l S %d 100 m %d 110 l %d 100 l S " % (n, n + 20, n, n + 10, n + 20) + b"%d 120 m %d 140 l %d 120 l h S %d 150 m %d 170 %d 170 %d 150 c S n 5 5 m 9 9 l n" % (n, n + 10, n + 20, n, n, n + 30, n + 30))

    return _boxes(spark, sf_dir, build, "vectors", "object_type", F.size("pts").cast("long").alias("n_pts"))


OPERATORS = ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n")


@_query
def f13_paint(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b" ".join(b"%d %d 60 20 re %s" % (nation, 10 * k, op.encode()) for k, op in enumerate(OPERATORS)))

    return _boxes(spark, sf_dir, build, "vectors", "stroke", "fill", "evenodd")


@_query
def f2_matrices(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"q 2 0 0 3 10 20 cm %d %d 10 10 re f q 0 1 -1 0 40 0 cm 0 0 5 2 re f Q Q %d 0 5 5 re f" % (nation, nation, nation))

    return _boxes(spark, sf_dir, build)


@_query
def f5_colours(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"0.5 g 0.25 G 0 0 9 9 re B 1 0 0.5 rg 0 10 9 9 re f 0 1 0 0.25 k 0 20 9 9 re f /DeviceRGB cs 0.1 0.2 0.%d sc 0 30 9 9 re f q 0 g Q 0 40 9 9 re f" % (nation + 10))

    fill, stroke = F.col("non_stroking_color"), F.col("stroking_color")
    add = lambda c: F.round(F.aggregate(c["components"], F.lit(0.0), lambda a, x: a + x), 6)
    return _boxes(spark, sf_dir, build, "vectors", F.size(fill["components"]).cast("long").alias("n"), add(fill).alias("total"), F.when(F.col("stroke"), add(stroke)).alias("stroked"), "linewidth")


@_query
def s20_images(spark, sf_dir):
    def build(key, name, nation):
        n = nation
        image = writer.stream(bytes(3 * (4 + n)), b"/Type /XObject /Subtype /Image /Width %d /Height 3 /BitsPerComponent 8 /ColorSpace /DeviceGray" % (4 + n))
        form = writer.stream(b"q 5 0 0 5 0 0 cm /Im Do Q", b"/Type /XObject /Subtype /Form /BBox [0 0 99 99] /Matrix [2 0 0 2 1 1] /Resources << /XObject << /Im 6 0 R >> >>")
        content = b"q %d 0 0 40 10 20 cm /Im Do Q q 1 0 0 1 %d 50 cm /Fm Do Q q 8 0 0 8 0 0 cm BI /W 2 /H 2 /BPC 1 /IM true ID ab EI Q" % (30 + n, n)
        return one_page(content, b"/XObject << /Im 6 0 R /Fm 7 0 R >>", more={6: image, 7: form})

    return _boxes(spark, sf_dir, build, "images", "name", F.col("srcsize")[0].alias("w"), F.col("srcsize")[1].alias("h"), "imagemask", "colorspace")


@_query
def s22_marked_content(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"/P << /MCID %d >> BDC BT /F1 10 Tf (a) Tj ET /Span BMC BT /F1 9 Tf (b) Tj ET EMC EMC BT /F1 9 Tf (c) Tj ET /H1 /Pr BDC BT /F1 9 Tf (d) Tj ET EMC" % nation, FONTS + b" /Properties << /Pr << /MCID 99 >> >>")

    made = reader.decode(_files(spark, sf_dir, build), "chars")
    return made.select("doc_id", "text", F.coalesce(F.col("mcid").cast("long"), F.lit(-1)).alias("mcid"), F.coalesce("tag", F.lit("")).alias("tag"))


@_query
def s23_type0(spark, sf_dir):
    def build(key, name, nation):
        cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <%04x> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfchar <0020> <00660069> endbfchar" % (65 + nation)
        font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [11 0 R] /ToUnicode 10 0 R >>"
        below = b"<< /Type /Font /Subtype /CIDFontType2 /DW 700 /W [1 [500] 16 18 250] /FontDescriptor << /Ascent 800 /Descent -200 >> >>"
        return one_page(b"BT /F2 10 Tf 10 10 Td <00010010001200200099> Tj ET", b"/Font << /F2 12 0 R >>", more={10: writer.stream(cmap, compress=True), 11: below, 12: font})

    return _boxes(spark, sf_dir, build, "chars", "text")


@_query
def s24_differences(spark, sf_dir):
    def build(key, name, nation):
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Own /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni0416 /Euro 90 /a] >> /FirstChar 65 /Widths [500 600 %d] /FontDescriptor << /Ascent 700 /Descent -300 /MissingWidth 400 >> >>" % (700 + nation)
        return one_page(b"BT /F2 10 Tf 10 10 Td (ABCZd) Tj ET", b"/Font << /F2 12 0 R >>", more={12: font})

    return _boxes(spark, sf_dir, build, "chars", "text")


@_query
def s25_standard_widths(spark, sf_dir):
    def build(key, name, nation):
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % (b"Helvetica" if key % 2 else b"Times-Roman")
        return one_page(b"BT /F2 10 Tf %d 10 Td (Wi.) Tj ET" % nation, b"/Font << /F2 12 0 R >>", more={12: font})

    return _boxes(spark, sf_dir, build, "chars", "text")


@_query
def s29_page_boxes(spark, sf_dir):
    def build(key, name, nation):
        return one_page(b"", entries=b"/CropBox [10 20 150 250] /Rotate %d" % (90 * (key % 4)))

    box = lambda c: [F.col(f"{c}.{k}").alias(f"{c}_{k}") for k in ("x0", "top", "x1", "bottom")]
    return reader.decode(_files(spark, sf_dir, build), "pages").select("doc_id", "width", "height", *box("bbox"), *box("cropbox"))


@_query
def s31_errors(spark, sf_dir):
    def build(key, name, nation):
        broken = one_page({4: writer.stream(b"\xff", b"/Filter /ASCII85Decode")})
        return [one_page(rect(nation)), b"no file at all", broken][key % 3]

    made = reader.decode_kinds(_files(spark, sf_dir, build), ("documents", "vectors"))
    key = F.coalesce("documents.doc_id", "vectors.doc_id").alias("doc_id")
    return made.groupBy(key).agg(F.max("documents.error.name").alias("error"), F.max(F.col("documents.page_count").cast("long")).alias("page_count"), F.count_if(F.col("kind") == "vectors").alias("n"))


@_query
def s34_objects(spark, sf_dir):
    from .decoding import _reports

    return PageSet.open(spark, _reports(spark, sf_dir)).objects.groupBy("doc_id", "object_type").agg(F.count(F.lit(1)).alias("n"), F.sum("x0").alias("x0"))


@_query
def f10_strings(spark, sf_dir):
    def build(key, name, nation):
        wide = name + "é€"
        raw = [name.encode() + b"\xe9\xa0", b"\xfe\xff" + wide.encode("utf-16-be"), b"\xef\xbb\xbf" + wide.encode(), b"\xff\xfe" + wide.encode("utf-16-le")][key % 4]
        return one_page(b"", more={8: b"<< /Title %s /Author <%s> >>" % (writer.escape(raw), name.encode().hex().encode())}, extra=b"/Info 8 0 R")

    made = reader.decode(_files(spark, sf_dir, build), "documents")
    return made.select("doc_id", F.col("metadata")["Title"].alias("title"), F.col("metadata")["Author"].alias("author"))


@_query
def f11_normal_forms(spark, sf_dir):
    def build(key, name, nation):
        cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <41> <fb01> <42> <%04x> endbfchar" % (0xFF21 + nation)
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /ToUnicode 10 0 R >>"
        return one_page(b"BT /F2 10 Tf (AB) Tj ET", b"/Font << /F2 12 0 R >>", more={10: writer.stream(cmap), 12: font})

    made = reader.decode(_files(spark, sf_dir, build), "chars", unicode_norm="NFKC")
    return made.select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


@_query
def p12_hyperlinks(spark, sf_dir):
    def build(key, name, nation):
        note = b"<< /Type /Annot /Subtype /Text /Rect [%d 20 50 40] /T (someone) /Contents %s >>" % (nation, writer.escape(name.encode()))
        links = b"<< /Subtype /Link /Rect [30 40 10 20] /A << /URI (http://a/%d) >> >> << /Subtype /Link /Rect [1 2 3 4] /URI (http://b) >> << /Subtype /Link >>" % key
        return one_page(b"", entries=b"/Annots [%s %s]" % (note, links))

    pages = PageSet.open(spark, _files(spark, sf_dir, build))
    links = pages.hyperlinks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"), F.max("uri").alias("last"))
    return pages.annots.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("contents").alias("contents"), F.max("title").alias("title"), F.sum("x0").alias("x0")).join(links, "doc_id")
