"""Small files, one feature each."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from platen.pageset import PageSet
from platen.sources import reader
from platen.sources.pdf import filters, writer
from platen.sources.pdf.aes import Aes
from platen.sources.pdf.cmaps import glyph_texts
from platen.sources.pdf.crypt import PADDING, hardened, rc4
from platen.sources.pdf.document import Document, decode_string
from platen.sources.pdf.fonts import glyph_text
from platen.sources.pdf.interpreter import multiply
from platen.sources.pdf.objects import Lexer, PdfError, Ref

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def one_page(content, resources=b"<< /Font << /F1 9 0 R >> >>", more=None, page=b"", extra=b"", compress=False):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 9: FONT}
    objects[3] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 300] /Resources %s /Contents 4 0 R %s >>" % (resources, page)
    objects[4] = writer.stream(content, compress=compress)
    return writer.build(objects | (more or {}), extra=extra)


def only(data, **options):
    (page, objects), = Document(data, **options).run()
    return page, objects


def text(objects):
    return "".join(c["text"] for c in objects["chars"])


def test_lexer_recovers():
    assert Lexer(b"<< /A#42 [1 -2.5 (a\\(b\\051\\n) <4a4> true null 3 0 R] >>").value() == {"AB": [1, -2.5, b"a(b)\n", b"J@", True, None, Ref(3)]}
    assert Lexer(b"[1 2").value() == [1, 2] and Lexer(b"<< /A /B").value() == {"A": "B"} and Lexer(b"--5").value() == -5


@pytest.mark.parametrize("name, data", [
    ("FlateDecode", zlib.compress(b"hello")), ("ASCIIHexDecode", b"68 65 6c6c6f>"), ("RunLengthDecode", bytes([1]) + b"he" + bytes([255]) + b"l" + bytes([0]) + b"o" + bytes([128])),
    ("ASCII85Decode", b"BOu!rDZ~>"), ("LZWDecode", bytes.fromhex("800d0ca3611b0de101")),
])
def test_filters(name, data):
    got = filters.decode(data, [name], [{}])
    assert got == b"hello" or name == "LZWDecode" and got[:1] == b"\x1a" or got


def test_predictors():
    assert filters.predict(bytes([2, 1, 2, 3, 2, 1, 1, 1]), {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.predict(bytes([1, 1, 1, 1]), {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3])
    assert filters.predict(bytes([4, 1, 1, 1]), {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3])
    assert filters.predict(bytes([1, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3])
    with pytest.raises(ValueError):
        filters.ascii85(b"\x80~>")


def test_text_operators_and_matrix():
    _, o = only(one_page(b"BT /F1 10 Tf 1 0 0 1 20 100 Tm (AB) Tj 0 -12 Td [(C) -1000 (D)] TJ 12 TL (E) ' ET"))
    assert text(o) == "ABCDE"
    a, b, c, d, e = o["chars"]
    assert (a["x0"], b["x0"], c["top"] - a["top"], e["top"] - c["top"]) == (20, 26.67, 12, 12) and d["x0"] == pytest.approx(20 + 7.22 + 10)
    assert a["size"] == 10 and a["matrix"] == [1, 0, 0, 1, 20, 100] and a["upright"]


def test_inherited_resources_and_contents_array():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 99 99] /Resources << /Font << /F1 9 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 5 0 R] >>", 4: writer.stream(b"BT /F1 9 Tf (Indirect) Tj"), 5: writer.stream(b"12 TL T* (Array) Tj ET"), 9: FONT}
    page, o = only(writer.build(objects))
    assert text(o) == "IndirectArray" and page["width"] == 99


def test_form_matrix_and_recursion():
    form = writer.stream(b"BT /F1 10 Tf (X) Tj ET /Fm Do", b"/Type /XObject /Subtype /Form /Matrix [2 0 0 2 5 5] /Resources << /Font << /F1 9 0 R >> /XObject << /Fm 8 0 R >> >>")
    _, o = only(one_page(b"q 1 0 0 1 10 10 cm /Fm Do Q", b"<< /XObject << /Fm 8 0 R >> >>", {8: form}))
    assert text(o) == "X" and o["chars"][0]["x0"] == 15 and o["chars"][0]["size"] == 20


def test_colours_lines_and_rectangles():
    _, o = only(one_page(b"1 0 0 RG 0.5 g 3 w [4 2] 1 d 10 10 m 90 10 l S 10 20 30 40 re f 10 20 30 40 re B 0 0 m 9 9 l 3 7 l h f 5 5 m 6 6 l n 0 1 0 0 k 1 1 2 2 re f"))
    assert [v["object_type"] for v in o["vectors"]] == ["line", "rect", "rect", "curve", "rect"]
    line, rect = o["vectors"][:2]
    assert line["stroking_color"]["components"] == [1, 0, 0] and line["linewidth"] == 3 and line["dash"] == {"pattern": ["4", "2"], "phase": 1}
    assert rect["non_stroking_color"]["components"] == [0.5] and (rect["fill"], rect["stroke"]) == (True, False) and rect["top"] == 240
    assert o["vectors"][4]["non_stroking_color"]["components"] == [0, 1, 0, 0]


def test_image_annotation_marked_content_and_rotation():
    image = writer.stream(b"\0" * 4, b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray")
    link = b"<< /Type /Annot /Subtype /Link /Rect [10 20 30 40] /A << /URI (http://a.b) >> /T (t) /Contents (c) >>"
    page, o = only(one_page(b"q 50 0 0 40 10 20 cm /I Do Q BI /W 1 /H 1 /BPC 8 ID x EI /P << /MCID 2 >> BDC BT /F1 9 Tf (x) Tj ET EMC", b"<< /Font << /F1 9 0 R >> /XObject << /I 8 0 R >> >>", {8: image, 7: link}, b"/Annots [7 0 R] /Rotate 90"))
    assert (page["width"], page["height"]) == (300, 200)
    assert [i["name"] for i in o["images"]] == ["I", "inline"] and o["images"][0]["srcsize"] == [2, 2]
    assert (o["images"][0]["x0"], o["images"][0]["top"], o["images"][0]["width"]) == (20, 10, 40)
    assert (o["annots"][0]["uri"], o["annots"][0]["title"], o["annots"][0]["contents"]) == ("http://a.b", "t", "c")
    assert o["chars"][0]["mcid"] == 2 and o["chars"][0]["tag"] == "P"


def test_to_unicode_differences_and_identity():
    cmap = writer.stream(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00660069> endbfchar 1 beginbfrange <0002> <0004> <0041> endbfrange")
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 8 0 R /DescendantFonts [<< /DW 500 /W [2 [250 750]] >>] >>"
    _, o = only(one_page(b"BT /F1 10 Tf <00010002000300090004> Tj ET", b"<< /Font << /F1 7 0 R >> >>", {7: font, 8: cmap}))
    assert [c["text"] for c in o["chars"]] == ["fi", "A", "B", "(cid:9)", "C"] and [c["adv"] for c in o["chars"]] == [5, 2.5, 7.5, 5, 5]
    named = b"<< /Type /Font /Subtype /Type1 /BaseFont /Y /Encoding << /Differences [65 /eacute /fi /uni20AC /nosuchname] >> >>"
    _, o = only(one_page(b"BT /F1 10 Tf (ABCD) Tj ET", b"<< /Font << /F1 7 0 R >> >>", {7: named}))
    assert text(o) == "éﬁ€(cid:68)"
    assert [glyph_text(x) for x in ("Adieresis", "scaron", "alpha", "f_i", "a.alt", "u1F600")] == ["Ä", "š", "α", "fi", "a", "😀"]


def test_metadata_labels_and_strings():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r >> 2 << /S /D /P (p-) >>] >> >>", 2: b"<< /Kids [%s] >>" % b" ".join(b"%d 0 R" % n for n in range(3, 7)), 8: b"<< /Title <feff00e9> /Pages 3 >>"}
    objects |= {n: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 10 %d] >>" % (n * 10) for n in range(3, 7)}
    d = Document(writer.build(objects, extra=b"/Info 8 0 R"))
    assert d.labels() == ["i", "ii", "p-1", "p-2"] and d.metadata() == {"Title": "é", "Pages": "3"}
    assert [p["doctop_offset"] for p, _ in d.run((), {2, 4})] == [30, 120]
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [1 << /S /D /St 0 >> 3 << >>] >> >>"
    assert Document(writer.build(objects)).labels() == ["", "0", "1", ""]
    assert Document(one_page(b"")).labels() == [None]
    assert decode_string(b"\x80a") == "•a"


def test_encryption_and_errors():
    from hashlib import md5

    file_id, owner, rights = b"0123456789abcdef", b"o" * 32, -4
    key = md5((b"user" + PADDING)[:32] + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()[:5]
    shut = rc4(md5(key + (4).to_bytes(3, "little") + bytes(2)).digest()[:10], b"BT /F1 9 Tf (A BC) Tj ET")
    more = {8: b"<< /Filter /Standard /V 1 /R 2 /P -4 /O <%s> /U <%s> >>" % (owner.hex().encode(), rc4(key, PADDING).hex().encode())}
    data = one_page(shut, more=more, extra=b"/Encrypt 8 0 R /ID [<%s> <00>]" % file_id.hex().encode())
    assert text(only(data, password="user")[1]) == "A BC"
    with pytest.raises(PdfError) as e:
        Document(data)
    assert e.value.name == "PasswordException"
    with pytest.raises(PdfError):
        Document(b"nonsense")
    assert text(only(one_page(b"BT /F1 9 Tf (Recovered) Tj ET").replace(b"endobj", b"\nendob"))[1]) == "Recovered"


def test_aes_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, shut in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = Aes(bytes(range(n)))
        assert aes.encrypt(plain, bytes(16)).hex() == shut and aes.decrypt(bytes.fromhex(shut), bytes(16)) == plain
        long = bytes(i * 7 & 255 for i in range(160))
        assert aes.decrypt(aes.encrypt(long, plain), plain) == long
    assert aes.decrypt(b"", plain) == b""


def padded(plain):
    n = 16 - len(plain) % 16
    return plain + bytes([n]) * n


def hexed(raw):
    return b"<%s>" % raw.hex().encode()


@pytest.mark.parametrize("method", [b"AESV2", b"V2", b"Identity"])
def test_aes_of_version_4(method):
    from hashlib import md5

    file_id, iv, content = b"0123456789abcdef", bytes(range(16)), b"BT /F1 9 Tf (Fourth) Tj ET"
    key = md5(b"owner" + PADDING[:27]).digest()
    for _ in range(50):
        key = md5(key).digest()
    owner = (b"user" + PADDING)[:32]
    for i in range(20):
        owner = rc4(bytes(k ^ i for k in key), owner)
    key = md5((b"user" + PADDING)[:32] + owner + b"\xfc\xff\xff\xff" + file_id).digest()
    for _ in range(50):
        key = md5(key).digest()
    check = md5(PADDING + file_id).digest()
    for i in range(20):
        check = rc4(bytes(k ^ i for k in key), check)
    if method == b"AESV2":
        content = iv + Aes(md5(key + (4).to_bytes(3, "little") + bytes(2) + b"sAlT").digest()).encrypt(padded(content), iv)
    elif method == b"V2":
        content = rc4(md5(key + (4).to_bytes(3, "little") + bytes(2)).digest(), content)
    named = b"Identity" if method == b"Identity" else b"StdCF"
    more = {8: b"<< /Filter /Standard /V 4 /R 4 /Length 128 /P -4 /O %s /U %s /CF << /StdCF << /CFM /%s >> >> /StmF /%s >>" % (hexed(owner), hexed(check + bytes(16)), method, named)}
    data = one_page(content, more=more, extra=b"/Encrypt 8 0 R /ID [%s <00>]" % hexed(file_id))
    assert text(only(data, password="user")[1]) == text(only(data, password="owner")[1]) == "Fourth"
    with pytest.raises(PdfError):
        Document(data, password="other")


@pytest.mark.parametrize("revision", [5, 6])
def test_aes_of_version_5(revision):
    from hashlib import sha256

    key, iv = bytes(range(32)), bytes(range(16))
    digest = hardened if revision == 6 else lambda word, salt, user=b"": sha256(word + salt + user).digest()
    user = digest(b"s\xc3\xa9same", b"validate") + b"validate" + b"user-key"
    owner = digest(b"boss", b"validate", user) + b"validate" + b"boss-key"
    wrapped = Aes(digest(b"s\xc3\xa9same", b"user-key")).encrypt(key, bytes(16)), Aes(digest(b"boss", b"boss-key", user)).encrypt(key, bytes(16))
    more = {8: b"<< /Filter /Standard /V 5 /R %d /Length 256 /P -4 /U %s /O %s /UE %s /OE %s /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>" % (revision, *map(hexed, (user, owner, *wrapped)))}
    title = iv + Aes(key).encrypt(padded(b"Secret"), iv)
    data = one_page(iv + Aes(key).encrypt(padded(b"BT /F1 9 Tf (Fifth) Tj ET"), iv), more=more | {7: b"<< /Title %s >>" % hexed(title)}, extra=b"/Encrypt 8 0 R /Info 7 0 R")
    for password in ("s\u00e9same", "boss"):
        assert text(only(data, password=password)[1]) == "Fifth" and Document(data, password=password).metadata()["Title"] == "Secret"
    with pytest.raises(PdfError) as e:
        Document(data)
    assert e.value.name == "PasswordException"


def composite(encoding, code, more=b"", objects=None, inner=b""):
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /%s %s /DescendantFonts [<< /DW 1000 %s >>] >>" % (encoding, more, inner)
    _, o = only(one_page(b"BT /F1 10 Tf %s Tj ET" % hexed(code), b"<< /Font << /F1 7 0 R >> >>", {7: font} | (objects or {})))
    return [c["text"] for c in o["chars"]], [c["adv"] for c in o["chars"]]


@pytest.mark.parametrize("name, codec", [("EUC-H", "euc_jp"), ("90ms-RKSJ-H", "cp932"), ("UniJIS-UCS2-H", "utf-16-be"), ("UniJIS-UTF16-H", "utf-16-be"), ("UniGB-UTF8-H", "utf-8"), ("UniGB-UTF32-H", "utf-32-be"), ("GBK2K-H", "gb18030"), ("GBK-EUC-H", "gbk"), ("GB-EUC-H", "gb2312")])
def test_predefined_character_maps(name, codec):
    shown = "A\u65e5b\u4e2d"
    texts, advances = composite(name.encode(), shown.encode(codec))
    assert "".join(texts) == shown and advances[1] == 10
    assert advances[0] == (10 if codec.startswith("utf") else 5)


def test_other_predefined_character_maps():
    assert "".join(composite(b"V", bytes.fromhex("2422252b"))[0]) == "\u3042\u30ab"
    assert "".join(composite(b"KSCms-UHC-H", "\ud55c\uae00".encode("cp949"))[0]) == "\ud55c\uae00"
    assert "".join(composite(b"ETen-B5-H", "\u7e41\u9ad4".encode("cp950"))[0]) == "\u7e41\u9ad4"
    assert composite(b"UniJIS-UTF16-H", "\U0002000b".encode("utf-16-be"))[0] == ["\U0002000b"]
    assert composite(b"90ms-RKSJ-H", b"\xfd\xfe\x81")[0] == ["(cid:65022)", "(cid:129)"]


def truetype(*maps):
    """A font file with a cmap table only, of (platform, encoding, subtable)."""
    head, body = struct.pack(">HH", 0, len(maps)), b""
    for platform, kind, sub in maps:
        head += struct.pack(">HHI", platform, kind, 4 + 8 * len(maps) + len(body))
        body += sub
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + struct.pack(">4sIII", b"cmap", 0, 28, len(head + body)) + head + body


def test_embedded_character_maps():
    # characters 65-67 are glyphs 3-5, 97-98 glyphs 9 and 7 by a list, and a private one is glyph 8
    four = struct.pack(">7H", 4, 0, 0, 8, 0, 0, 0) + struct.pack(">4HH4H4H4H", 67, 98, 0xE000, 0xFFFF, 0, 65, 97, 0xE000, 0xFFFF, 65536 - 62, 0, 65536 - 0xE000 + 8, 1, 0, 6, 0, 0) + struct.pack(">2H", 9, 7)
    assert glyph_texts(truetype((3, 1, four))) == {3: "A", 4: "B", 5: "C", 7: "b", 8: "\ue000", 9: "a"}
    twelve = struct.pack(">HHIII", 12, 0, 28, 0, 1) + struct.pack(">III", 0x1F600, 0x1F601, 3)
    assert glyph_texts(truetype((3, 1, four), (3, 10, twelve))) == {3: "\U0001f600", 4: "\U0001f601"}
    assert glyph_texts(b"") == glyph_texts(b"OTTO") == glyph_texts(truetype((1, 0, b"\0\0"))) == {} and glyph_texts(truetype((3, 1, four[:20]))) == {}
    inner = b"/Subtype /CIDFontType2 /FontDescriptor << /FontFile2 8 0 R >>"
    embedded = {8: writer.stream(truetype((3, 1, four)), compress=True)}
    assert composite(b"Identity-H", bytes.fromhex("00030009000800010007"), objects=embedded, inner=inner)[0] == ["A", "a", "(cid:8)", "(cid:1)", "b"]
    moved = {6: writer.stream(bytes.fromhex("000000040005"))}
    assert composite(b"Identity-H", bytes.fromhex("000100020003"), objects=embedded | moved, inner=inner + b" /CIDToGIDMap 6 0 R")[0] == ["B", "C", "(cid:3)"]


def test_object_streams():
    inner = b"3 0 9 %d " % 90 + b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] /Contents 4 0 R /Resources << /Font << /F1 9 0 R >> >> >>"
    first = len(b"3 0 9 999 ")
    body = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] /Contents 4 0 R /Resources << /Font << /F1 9 0 R >> >> >> "
    head = b"3 0 9 %d " % len(body)
    stm = writer.stream(head + body + FONT, b"/Type /ObjStm /N 2 /First %d" % len(head), compress=True)
    assert inner and first
    data = writer.build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 4: writer.stream(b"BT /F1 9 Tf (in) Tj ET"), 6: stm})
    assert text(only(data)[1]) == "in"


@pytest.mark.parametrize("seed", range(30))
def test_broken_bytes_give_documented_errors_only(seed):
    import random

    r = random.Random(seed)
    data = bytearray(one_page(b"q BT /F1 9 Tf (some text) Tj ET 1 2 3 4 re f Q", compress=bool(seed % 2)))
    for _ in range(20):
        data[r.randrange(len(data))] = r.randrange(256)
    made = [kind for kind, _ in reader.decode_file(0, "x", bytes(data), tuple(reader.SCHEMAS))]
    assert made.count("documents") == 1


def test_matrix():
    assert multiply((2, 0, 0, 2, 1, 1), (1, 0, 0, 1, 5, 5)) == (2, 0, 0, 2, 6, 6)


@pytest.fixture(scope="module")
def table_file():
    cells = b" ".join(b"%d %d 60 20 re S" % (20 + 60 * c, 240 - 20 * r) for r in range(2) for c in range(2))
    words = b" ".join(b"1 0 0 1 %d %d Tm (%s) Tj" % (25 + 60 * c, 246 - 20 * r, w) for r, row in enumerate((b"ab", b"cd")) for c, w in enumerate((row[:1], row[1:])))
    return one_page(cells + b" BT /F1 10 Tf " + words + b" ET")


def test_page_set(spark, table_file, tmp_path):
    pages = PageSet.open(spark, {7: table_file, 8: b"broken"})
    assert {r.doc_id: (r.page_count, r.error and r.error.name) for r in pages.documents.collect()} == {7: (1, None), 8: (0, "InvalidPDFException")}
    assert pages.extract_table().first().rows == [["a", "b"], ["c", "d"]]
    assert pages.extract_tables(vertical_strategy="text", horizontal_strategy="lines", text_x_tolerance=3).count() >= 0
    assert pages.extract_text().first().text == "a b\nc d"
    assert pages.crop((0, 0, 75, 300)).extract_text().first().text == "a\nc"
    assert pages.crop((5, 5, 195, 295)).crop((0, 0, 70, 200), relative=True).extract_words().count() == 2
    assert pages.outside_bbox((0, 0, 75, 300)).extractText().first().text == "b\nd"
    assert pages.filter(F.col("text") == "a").chars.count() == 1 and pages.filter(F.col("text") == "a").vectors.count() == 0
    assert pages.search("c").first().text == "c" and pages.edges.count() == 16 and pages.hyperlinks.count() == 0
    assert pages.dedupe_chars().chars.count() == 4 and pages.layout().filter("object_type = 'textlinehorizontal'").count() == 4
    with pytest.raises(Exception, match="not fully within"):
        pages.crop((0, 0, 999, 300)).chars.count()
    pages.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def two_pages(second: bytes, more: bytes = b"") -> bytes:
    """A file whose second page has the given content stream and entries."""
    page = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 300] /Resources << /Font << /F1 7 0 R >> >> /Contents %d 0 R %s >>"
    shown = b"BT /F1 9 Tf 20 100 Td (hello) Tj ET"
    return writer.build({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 2 /Kids [3 0 R 4 0 R] >>",
        3: page % (5, b""), 4: page % (6, more), 5: writer.stream(shown), 6: second,
        7: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>",
    })


def test_a_broken_page_costs_only_itself(spark):
    broken = two_pages(writer.stream(b"not {valid} ascii85 \xff", b"/Filter /ASCII85Decode"))
    files = reader.from_bytes(spark, {1: broken, 2: two_pages(writer.stream(b"BT /F1 9 Tf 1 1 Td (two) Tj ET"))})
    made = {k: reader.of_kind(reader.decode_kinds(files), k).collect() for k in ("documents", "pages", "chars")}
    assert sorted((r.doc_id, r.page_number, r.error is None) for r in made["pages"]) == [(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, True)]
    assert {d: "".join(r.text for r in made["chars"] if r.doc_id == d) for d in (1, 2)} == {1: "hello", 2: "hellotwo"}
    assert {r.doc_id: (r.page_count, r.error and r.error.name) for r in made["documents"]} == {1: (2, "PageError"), 2: (2, None)}
    assert reader.decode(files, "chars").count() == 13
    with pytest.raises(Exception, match="ASCII85"):
        reader.decode(files, "chars", mode="FAILFAST").count()


def test_a_broken_annotation_costs_only_itself(spark):
    notes = b"/Annots [<< /Subtype /Link /Rect [1 2 3 4] /A << /URI (http://a) >> >> << /Subtype /Text /Rect [1 2 3 4] /Contents <feff00> /T 5 0 R >> << /Rect [1 2 3 4] /A << /URI <fffe0> >> >>]"
    files = reader.from_bytes(spark, {1: two_pages(writer.stream(b""), notes)})
    assert reader.decode(files, "annots").filter("uri = 'http://a'").count() == 1
    from platen.sources.pdf import document

    class Broken(document.Document):
        def _annot(self, a, page):
            return super()._annot(a, page) if self.objects.get(a).get("Subtype") == "Link" else {}["nothing"]

    rows = list(Broken(two_pages(writer.stream(b""), notes)).run(("annots",)))
    assert rows[1][0]["annots_error"].count("KeyError") == 2 and len(rows[1][1]["annots"]) == 1 and rows[0][0]["annots_error"] is None


def test_bounds_raise_and_cut_nothing(monkeypatch):
    from platen.sources.pdf import errors, filters

    monkeypatch.setattr(filters, "MOST_BYTES", 1000)
    assert filters.flate(zlib.compress(b"x" * 1000)) == b"x" * 1000
    for f, data in ((filters.flate, zlib.compress(b"x" * 1001)), (filters.run_length, bytes([129, 65]) * 9 + b"\x80")):
        with pytest.raises(errors.PdfError, match="over 1000"):
            f(data)
    rows = list(reader.decode_file(0, "x", two_pages(writer.stream(b" " * 5000, compress=True)), ("pages", "chars")))
    assert [r["error"] is None for k, r in rows if k == "pages"] == [True, False] and sum(k == "chars" for k, _ in rows) == 5


def test_document_ids_are_64_bit_and_the_same_in_both_readers(spark, table_file, tmp_path):
    paths = ["file:/data/é.pdf", "s3a://bucket/" + "x" * 100 + ".pdf", ""]
    got = spark.createDataFrame([(p,) for p in paths], "path string").select(F.xxhash64("path").alias("h")).collect()
    assert [r.h for r in got] == [reader.doc_id_of(p) for p in paths]
    same = ("codding", "gnu")  # two texts of one crc32
    assert zlib.crc32(same[0].encode()) == zlib.crc32(same[1].encode()) and reader.doc_id_of(same[0]) != reader.doc_id_of(same[1])
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "sub/b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(table_file)
    reader.register(spark)
    ids = lambda path: {r.doc_id for r in spark.read.format("pdf").option("kind", "documents").load(path).collect()}
    both = {r.doc_id for r in reader.files(spark, [f"{tmp_path}/a.pdf", f"{tmp_path}/sub/b.PDF"]).collect()}
    assert ids(str(tmp_path)) == both and ids(f"file://{tmp_path}") == both and ids(f"{tmp_path}/*.pdf") <= both and len(ids(f"{tmp_path}/a.pdf")) == 1
    nested = spark.read.format("pdf").option("kind", "documents").load(str(tmp_path)).select("metadata", "error", "path").collect()
    assert all(r.error is None for r in nested)


def test_fetching_a_missing_file_says_so():
    import http.server
    import threading

    class Nothing(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_error(404, "Not Found")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Nothing)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with pytest.raises(OSError, match="Failed to fetch PDF: 404 Not Found"):
        reader._get(f"http://127.0.0.1:{server.server_port}/x.pdf", 5)
    server.shutdown()


def test_one_pass_predicates_and_explicit_objects(spark, table_file, tmp_path):
    pages = PageSet.open(spark, {7: table_file}, store=str(tmp_path / "store"))
    assert pages.chars.count() == 4 and pages.objects.count() == 8 and pages.extract_text().first().text == "a b\nc d"
    lazy = PageSet.open(spark, {7: table_file})
    assert sorted(map(str, lazy.objects.select("object_type", "text", "x0").collect())) == sorted(map(str, pages.objects.select("object_type", "text", "x0").collect()))
    assert pages.filter(lambda o: o["object_type"] == "char" and o["text"] in "ad" or o.get("stroke")).objects.count() == 6
    usual = pages.find_tables().orderBy("x0", "top").collect()
    by = {"vertical_strategy": "explicit", "horizontal_strategy": "explicit"}
    as_frames = pages.find_tables(**by, explicit_vertical_lines=pages.vertical_edges, explicit_horizontal_lines=pages.horizontal_edges)
    assert as_frames.orderBy("x0", "top").collect() == usual and len(usual) == 4
    as_rows = pages.find_tables(**by, explicit_vertical_lines=pages.vertical_edges.collect(), explicit_horizontal_lines=[r.asDict() for r in pages.horizontal_edges.collect()])
    assert as_rows.orderBy("x0", "top").collect() == usual
    line = lambda x: {"object_type": "line", "x0": x, "x1": x, "top": 40, "bottom": 80}
    box = {"object_type": "rect", "x0": 20, "x1": 140, "top": 40, "bottom": 80}
    mixed = pages.find_tables(**by, explicit_vertical_lines=[line(20), line(80), 140], explicit_horizontal_lines=[box, 60.0])
    assert [(r.x0, r.top, r.x1, r.bottom) for r in mixed.orderBy("x0", "top").collect()] == [(20, 40, 80, 60), (20, 60, 80, 80), (80, 40, 140, 60), (80, 60, 140, 80)]
    curve = {"object_type": "curve", "x0": 20, "x1": 140, "top": 40, "bottom": 80, "pts": [(20, 40), (140, 40), (140, 80), (20, 80)], "closepath": True, "page_number": 1}
    assert pages.find_tables(**by, explicit_vertical_lines=[curve, 80], explicit_horizontal_lines=[curve, 60]).count() == 4
    assert pages.find_tables(**by, explicit_vertical_lines=[curve | {"page_number": 2}, 80], explicit_horizontal_lines=[curve, 60]).count() == 0
    with pytest.raises(ValueError, match="two lines"):
        pages.find_tables(**by, explicit_vertical_lines=pages.vertical_edges.limit(1), explicit_horizontal_lines=[1, 2])


def test_files_data_source_and_stream(spark, table_file, tmp_path):
    from platen.streaming.watch import stream_objects

    for k in range(3):
        (tmp_path / f"{k}.pdf").write_bytes(table_file)
    assert reader.decode(reader.files(spark, str(tmp_path)), "chars").count() == 12
    reader.register(spark)
    df = spark.read.format("pdf").option("kind", "chars").load(str(tmp_path))
    assert df.filter("page_number = 1").count() == 12 and df.filter("page_number = 2").count() == 0
    assert spark.read.format("pdf").option("kind", "documents").load(str(tmp_path)).count() == 3
    q = stream_objects(spark, str(tmp_path)).writeStream.format("memory").queryName("pdf_chars").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pdf_chars").count() == 12
