"""A whole file: pages, labels, metadata, annotations and, page by page, its objects."""

from __future__ import annotations

import json
import struct
import zlib

from .errors import PdfError
from .interpreter import Interpreter, Page
from .objects import Keyword, Name, Objects, Ref, Stream

#: What broken files raise.
BROKEN = (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, ArithmeticError, struct.error, zlib.error)
ALL = ("chars", "vectors", "images", "annots")
# Codes of the PDF document encoding that differ from Latin-1.
_DOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜")) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")) | {0xA0: "€"}


def decode_string(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 with a mark, else the PDF document encoding."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return "".join(_DOC.get(c, chr(c)) for c in raw)


def roman(n: int) -> str:
    digits = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))
    out = ""
    for letters, value in digits:
        out, n = out + letters * (n // value), n % value
    return out


def alpha(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


class Document:
    def __init__(self, data: bytes, password: str = "", unicode_norm: str | None = None, arrays: bool = False):
        """arrays: characters come as ``Glyphs``."""
        self.objects, self.norm, self.arrays, self.problems = Objects(data, password), unicode_norm, arrays, []
        if not self.objects.where:
            raise PdfError("InvalidPDFException", "no object was found")
        get = self.objects.get
        root = get(self.objects.trailer.get("Root"))
        if not isinstance(root, dict):
            root = next((d for n in self.objects.where if isinstance(d := get(Ref(n)), dict) and d.get("Type") == "Catalog"), {})
        self.root = root
        self.pages = list(self._walk(root.get("Pages"), {}, set()))
        if not self.pages:
            self.pages = [d for n in sorted(self.objects.where) if isinstance(d := get(Ref(n)), dict) and d.get("Type") == "Page"]
        if not self.pages:
            raise PdfError("InvalidPDFException", "no page was found")

    def _walk(self, node, inherited: dict, seen: set):
        key = node.number if isinstance(node, Ref) else id(node)
        node = self.objects.get(node)
        if key in seen or not isinstance(node, dict) or len(seen) > 100_000:
            return
        seen.add(key)
        own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
        kids = self.objects.get(node.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                yield from self._walk(kid, own, seen)
        else:
            yield own | node

    def _numbers(self, x, n: int = 4) -> list[float] | None:
        x = self.objects.get(x)
        if not isinstance(x, list) or len(x) < n:
            return None
        out = [self.objects.get(v) for v in x[:n]]
        return [float(v) for v in out] if all(isinstance(v, (int, float)) for v in out) else None

    def _box(self, x) -> tuple | None:
        v = self._numbers(x)
        return (min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])) if v else None

    def labels(self) -> list[str | None]:
        """Labels of all pages: the last range that starts at or before a page names it. Pages before the first range
        have an empty label, and those of a file without ranges none."""
        get, ranges, todo = self.objects.get, {}, [self.root.get("PageLabels")]
        while todo and len(ranges) < 100_000:
            node = get(todo.pop())
            if isinstance(node, dict):
                nums = get(node.get("Nums")) or []
                ranges |= {int(get(a)): get(b) for a, b in zip(nums[::2], nums[1::2]) if isinstance(get(a), (int, float))}
                todo += (get(node.get("Kids")) or [])[:1000]
        if not ranges:
            return [None] * len(self.pages)
        out: list[str | None] = []
        now, start = None, 0
        for i in range(len(self.pages)):
            if i in ranges:
                now, start = ranges[i], i
            if not isinstance(now, dict):
                out.append("")
                continue
            first = get(now.get("St"))
            n, style = (int(first) if isinstance(first, (int, float)) else 1) + i - start, str(get(now.get("S")) or "")
            text = {"D": str(n), "r": roman(n), "R": roman(n).upper(), "a": alpha(n), "A": alpha(n).upper()}.get(style, "")
            prefix = get(now.get("P"))
            out.append((decode_string(prefix) if isinstance(prefix, bytes) else "") + text)
        return out

    def plain(self, x, depth: int = 0):
        """A value in terms of JSON."""
        x = self.objects.get(x)
        if isinstance(x, bytes):
            return decode_string(x)
        if isinstance(x, (Name, Keyword)):
            return str(x)
        if isinstance(x, list):
            return [self.plain(v, depth + 1) for v in x] if depth < 8 else None
        if isinstance(x, Stream):
            return self.plain(x.dict, depth)
        if isinstance(x, dict):
            return {k: self.plain(v, depth + 1) for k, v in x.items() if k not in ("Parent", "P", "Popup")} if depth < 8 else None
        return x

    def metadata(self) -> dict[str, str]:
        info = self.objects.get(self.objects.trailer.get("Info"))
        made = self.plain(info) if isinstance(info, dict) else {}
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in made.items()}

    def page(self, number: int, offset: float) -> tuple[Page, dict]:
        d = self.pages[number - 1]
        media = self._box(d.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        rotate = self.objects.get(d.get("Rotate"))
        return Page(number, media, int(rotate) if isinstance(rotate, (int, float)) else 0, offset), d

    def _labels(self) -> list[str | None]:
        try:
            return self.labels()
        except BROKEN as e:
            self.problems.append(f"page labels: {e}")
            return [None] * len(self.pages)

    def _draw(self, page: Page, d: dict, kinds: set, out: dict) -> list[str]:
        """Fills ``out`` from the page's content; what was drawn before a problem stays. Returns the problems."""
        found, parts = [], []
        contents = self.objects.get(d.get("Contents"))
        for s in contents if isinstance(contents, list) else [contents]:
            try:
                if isinstance(s := self.objects.get(s), Stream):
                    parts.append(self.objects.bytes_of(s))
            except BROKEN as e:
                found.append(f"{type(e).__name__}: {e}")
        machine = Interpreter(self.objects, page, kinds, self.norm, self.arrays)
        try:
            resources = self.objects.get(d.get("Resources"))
            machine.run(b"\n".join(parts), resources if isinstance(resources, dict) else {})
        except BROKEN as e:
            found.append(f"{type(e).__name__}: {e}")
        for k in ("chars", "vectors", "images"):
            if k in kinds:
                out[k] = machine.glyphs() if k == "chars" and self.arrays else getattr(machine, k)
        return found

    def _notes(self, page: Page, d: dict, out: dict) -> list[str]:
        """Fills in the page's annotations; those that cannot be read are left out. Returns the problems."""
        found = []
        listed = self.objects.get(d.get("Annots"))
        for a in listed if isinstance(listed, list) else []:
            try:
                if r := self._annot(a, page):
                    out["annots"].append(r)
            except BROKEN as e:
                found.append(f"{type(e).__name__}: {e}")
        return found

    def run(self, kinds: tuple = ALL, wanted: set[int] | None = None):
        """(page row, objects by kind) of each wanted page; pages that are not wanted only add their height. Problems are
        the page's own: its row names them, and what could be decoded comes all the same."""
        offset, labels = 0.0, self._labels()
        for number in range(1, len(self.pages) + 1):
            out: dict[str, list[dict]] = {k: [] for k in kinds}
            try:
                page, d = self.page(number, offset)
            except BROKEN as e:
                page, d, broken = Page(number, (0.0, 0.0, 612.0, 792.0), 0, offset), {}, [f"{type(e).__name__}: {e}"]
            else:
                broken = []
            offset += page.height
            if wanted is not None and number not in wanted:
                continue
            row = {"page_number": number, "label": labels[number - 1], "width": page.width, "height": page.height, "rotate": page.rotate, "doctop_offset": page.offset} | self._boxes(page, d)
            if drawn := set(kinds) & {"chars", "vectors", "images"}:
                broken += self._draw(page, d, drawn, out)
            notes = self._notes(page, d, out) if "annots" in kinds else []
            yield row | {"annots_error": "; ".join(notes) or None, "error": "; ".join(broken) or None}, out

    def _boxes(self, page: Page, d: dict) -> dict:
        try:
            boxes = {k.lower(): self._box(d.get(k)) for k in ("CropBox", "ArtBox", "BleedBox", "TrimBox")}
        except BROKEN:
            boxes = dict.fromkeys(("cropbox", "artbox", "bleedbox", "trimbox"))
        boxes["mediabox"] = page.box
        placed = {}
        for k, b in boxes.items():
            shown = b and (not page.rotate % 180 or k in ("mediabox", "cropbox"))
            placed[k] = {c: v for c, v in page.place([b[:2], b[2:]]).items() if c in ("x0", "top", "x1", "bottom")} if shown else None
        return placed | {"bbox": placed["mediabox"]}

    def _annot(self, a, page: Page) -> dict | None:
        get, a = self.objects.get, self.objects.get(a)
        if not isinstance(a, dict) or not (box := self._box(a.get("Rect"))):
            return None
        action = get(a.get("A"))
        uri = get(a.get("URI")) or (get(action.get("URI")) if isinstance(action, dict) else None)
        text = lambda x: decode_string(x) if isinstance(x := get(x), bytes) else None
        return page.place([box[:2], box[2:]]) | {"object_type": "annot", "uri": decode_string(uri) if isinstance(uri, bytes) else None, "title": text(a.get("T")), "contents": text(a.get("Contents")), "data": json.dumps(self.plain(a), default=str)}
