"""A small writer of PDF files, for tests and round trips."""

from __future__ import annotations

import zlib


def escape(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def build(objects: dict[int, bytes], root: int = 1, extra: bytes = b"") -> bytes:
    """A file of numbered objects."""
    out = bytearray(b"%PDF-1.7\n")
    for n, body in sorted(objects.items()):
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    return bytes(out) + b"trailer\n<< /Root %d 0 R %s >>\nstartxref\n0\n%%%%EOF\n" % (root, extra)


def stream(data: bytes, extra: bytes = b"", compress: bool = False) -> bytes:
    if compress:
        data, extra = zlib.compress(data), extra + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n" % (len(data), extra) + data + b"\nendstream"


def text_pages(text: str, lines_per_page: int = 60, size: int = 10) -> bytes:
    """The text, line by line, in Courier; characters that its encoding lacks become question marks."""
    lines = text.split("\n")
    pages = [lines[i : i + lines_per_page] for i in range(0, len(lines), lines_per_page)]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"}
    kids = []
    for k, page in enumerate(pages):
        n = 4 + 2 * k
        shown = b"\n".join(escape(x.encode("latin-1", "replace")) + b" Tj T*" for x in page)
        body = b"BT /F1 %d Tf %d TL 36 760 Td\n" % (size, size + 2) + shown + b"\nET"
        objects[n] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = stream(body, compress=True)
        kids.append(b"%d 0 R" % n)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return build(objects)
