"""The content-stream machine: characters, lines, rectangles, curves and images of a page."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

import numpy as np

from .fonts import Font
from .objects import Keyword, Lexer, Name, Objects, Stream

MAX_FORMS = 8
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(a: tuple, b: tuple) -> tuple:
    """The matrix that applies a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def clean(x: float) -> float:
    return round(x, 6) + 0.0


def color(values: list, pattern: str | None = None) -> dict:
    return {"scalar": False, "components": [float(v) for v in values], "pattern": pattern}


BLACK = color([0.0])


def clean_all(x: np.ndarray) -> np.ndarray:
    """``clean`` of each value."""
    y = x * 1e6
    near = np.rint(y)
    out = near / 1e6 + 0.0
    odd = ~((np.abs(np.abs(y - near) - 0.5) >= 1e-3) & (np.abs(y) <= 2.0**40))
    for k in np.flatnonzero(odd).tolist():
        out[k] = clean(float(x[k]))
    return out


#: Of a character: what is its own, and what it can share with those beside it.
OWN = ("x0", "x1", "y0", "y1", "top", "bottom", "doctop", "width", "height", "size", "adv")
SHARED = ("page_number", "mcid", "tag", "object_type", "fontname", "upright", "ncs", "non_stroking_color", "stroking_color")


@dataclass(eq=False)
class Glyphs:
    """Characters of a page that follow each other, as arrays: ``columns`` of OWN and of the matrix's last two values, and
    what all of them share, with the matrix's first four. ``codes`` are places in ``texts``."""

    shared: dict
    matrix: list[float]
    texts: list[str]
    codes: np.ndarray
    columns: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.codes)

    def rows(self) -> list[dict]:
        own = zip(*(self.columns[c].tolist() for c in OWN))
        return [self.shared | dict(zip(OWN, v)) | {"text": self.texts[k], "matrix": [*self.matrix, e, f]} for k, v, e, f in zip(self.codes.tolist(), own, self.columns["e"].tolist(), self.columns["f"].tolist())]

    @classmethod
    def of(cls, rows: list[dict]) -> "Glyphs":
        """Rows that share what can be shared."""
        columns = {c: np.array([r[c] for r in rows], dtype=float) for c in OWN} | {c: np.array([r["matrix"][k] for r in rows], dtype=float) for k, c in ((4, "e"), (5, "f"))}
        return cls({c: rows[0][c] for c in SHARED}, rows[0]["matrix"][:4], [r["text"] for r in rows], np.arange(len(rows)), columns)


#: Fonts by their dictionaries, of those that refer to nothing.
_PLAIN: dict[tuple, Font] = {}


@dataclass(frozen=True)
class State:
    ctm: tuple = IDENTITY
    linewidth: float = 0.0
    dash: tuple | None = None
    stroking: dict = field(default_factory=lambda: BLACK)
    filling: dict = field(default_factory=lambda: BLACK)
    stroking_space: str = "DeviceGray"
    filling_space: str = "DeviceGray"
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


class Page:
    """Geometry of a page and the placing of raw boxes on it."""

    def __init__(self, number: int, mediabox: tuple, rotate: int, offset: float):
        self.number, self.box, self.rotate, self.offset = number, mediabox, rotate % 360, offset
        w, h = mediabox[2] - mediabox[0], mediabox[3] - mediabox[1]
        self.width, self.height = (h, w) if self.rotate in (90, 270) else (w, h)

    def point(self, x: float, y: float) -> tuple[float, float]:
        x0, y0, x1, y1 = self.box
        return {90: (y - y0, x - x0), 180: (x1 - x, y - y0), 270: (y1 - y, x1 - x)}.get(self.rotate, (x, y1 - y))

    def place(self, points: list[tuple[float, float]]) -> dict:
        """The box of raw points, in page coordinates."""
        on = [self.point(*p) for p in points]
        x0, x1 = clean(min(p[0] for p in on)), clean(max(p[0] for p in on))
        top, bottom = clean(min(p[1] for p in on)), clean(max(p[1] for p in on))
        if self.rotate:
            y0, y1 = clean(self.height - bottom), clean(self.height - top)
        else:
            y0, y1 = clean(min(p[1] for p in points)), clean(max(p[1] for p in points))
        return {"page_number": self.number, "x0": x0, "x1": x1, "y0": y0, "y1": y1, "top": top, "bottom": bottom, "doctop": clean(top + self.offset), "width": clean(x1 - x0), "height": clean(bottom - top)}


class Interpreter:
    def __init__(self, objects: Objects, page: Page, kinds: set[str], unicode_norm: str | None = None, arrays: bool = False):
        """arrays: characters are wanted as ``glyphs``."""
        self.objects, self.page, self.kinds, self.norm, self.arrays = objects, page, kinds, unicode_norm, arrays
        self.shown: list = []  # runs of characters, or the row of one
        self.chars: list[dict] = []
        self.vectors: list[dict] = []
        self.images: list[dict] = []
        self.fonts: dict[int, Font] = {}

    def run(self, data: bytes, resources: dict, ctm: tuple = IDENTITY, depth: int = 0, seen: tuple = ()) -> None:
        objects, get = self.objects, self.objects.get
        state, stack, args = State(ctm=ctm), [], []
        tm = tlm = IDENTITY
        path: list[tuple] = []
        marks: list[tuple[str, int | None]] = []
        lexer = Lexer(data)

        def resource(kind, name):
            return get((get(resources.get(kind)) or {}).get(str(name)))

        def mark():
            for tag, mcid in reversed(marks):
                if mcid is not None:
                    return {"mcid": mcid, "tag": tag}
            return {"mcid": None, "tag": marks[-1][0] if marks else None}

        def numbers(n):
            out = [float(a) if isinstance(a, (int, float)) and not isinstance(a, bool) else 0.0 for a in args]
            return ([0.0] * (n - len(out)) + out)[-n:] if n else out

        def paint(stroke, fill, evenodd=False, close=False):
            if close and path and path[-1][0] != "h":
                path.append(("h",))
            if (stroke or fill) and path and "vectors" in self.kinds:
                self._paint(path, state, stroke, fill, evenodd, mark())
            path.clear()

        def show(raw):
            nonlocal tm
            if isinstance(raw, bytes) and state.font is not None:
                tm = self._show(raw, state, tm, mark())

        def set_color(stroking, values, space=None, pattern=None):
            made = color(values, pattern)
            return replace(state, **({"stroking": made} if stroking else {"filling": made}), **({("stroking_space" if stroking else "filling_space"): space} if space else {}))

        while True:
            x = lexer.value(False)
            if not isinstance(x, Keyword):
                args.append(x)
                if len(args) > 512:
                    del args[:256]
                continue
            op = str(x)
            if op == "" and lexer.at >= len(data):
                break
            if op == "q":
                if len(stack) < 512:
                    stack.append(state)
            elif op == "Q":
                state = stack.pop() if stack else state
            elif op == "cm":
                state = replace(state, ctm=multiply(tuple(numbers(6)), state.ctm))
            elif op == "w":
                state = replace(state, linewidth=numbers(1)[0])
            elif op == "d":
                pattern = args[-2] if len(args) > 1 and isinstance(args[-2], list) else []
                state = replace(state, dash=([str(p) for p in pattern], numbers(1)[0]))
            elif op == "gs":
                made = resource("ExtGState", args[-1]) if args else None
                if isinstance(made, dict):
                    if isinstance(w := get(made.get("LW")), (int, float)):
                        state = replace(state, linewidth=float(w))
                    if isinstance(f := get(made.get("Font")), list) and len(f) == 2:
                        state = replace(state, font=self._font(get(f[0])), size=float(get(f[1]) or 0))
            elif op in ("m", "l"):
                path.append((op, *numbers(2)))
            elif op == "c":
                path.append(("c", *numbers(6)))
            elif op in ("v", "y"):
                a = numbers(4)
                here = path[-1][-2:] if path and len(path[-1]) > 2 else (a[0], a[1])
                path.append(("c", *(here if op == "v" else a[:2]), *(a[:2] if op == "v" else a[2:]), *a[2:]))
            elif op == "h":
                path.append(("h",))
            elif op == "re":
                a, b, w, h = numbers(4)
                path += [("m", a, b), ("l", a + w, b), ("l", a + w, b + h), ("l", a, b + h), ("h",)]
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                paint(op[0] in "SsBb", op[0] in "fFBb", op.endswith("*"), op[0] in "sb")
            elif op == "BT":
                tm = tlm = IDENTITY
            elif op in ("Tc", "Tw", "TL", "Ts"):
                state = replace(state, **{{"Tc": "char_space", "Tw": "word_space", "TL": "leading", "Ts": "rise"}[op]: numbers(1)[0]})
            elif op == "Tz":
                state = replace(state, scale=numbers(1)[0] / 100)
            elif op == "Tf" and len(args) > 1:
                state = replace(state, font=self._font(resource("Font", args[-2])), size=numbers(1)[0])
            elif op in ("Td", "TD"):
                a, b = numbers(2)
                if op == "TD":
                    state = replace(state, leading=-b)
                tm = tlm = multiply((1, 0, 0, 1, a, b), tlm)
            elif op == "Tm":
                tm = tlm = tuple(numbers(6))
            elif op in ("T*", "'", '"'):
                if op == '"':
                    a = numbers(0)[:2] if len(args) > 2 else [0.0, 0.0]
                    state = replace(state, word_space=a[0], char_space=a[1])
                tm = tlm = multiply((1, 0, 0, 1, 0, -state.leading), tlm)
                if op != "T*" and args:
                    show(args[-1])
            elif op == "Tj" and args:
                show(args[-1])
            elif op == "TJ" and args and isinstance(args[-1], list):
                for part in args[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        by = -part / 1000 * state.size
                        tm = multiply((1, 0, 0, 1, 0, by) if state.font and state.font.vertical else (1, 0, 0, 1, by * state.scale, 0), tm)
            elif op in ("g", "G"):
                state = set_color(op == "G", numbers(1), "DeviceGray")
            elif op in ("rg", "RG"):
                state = set_color(op == "RG", numbers(3), "DeviceRGB")
            elif op in ("k", "K"):
                state = set_color(op == "K", numbers(4), "DeviceCMYK")
            elif op in ("cs", "CS") and args:
                space = get(resource("ColorSpace", args[-1])) or args[-1]
                name = str(get(space[0])) if isinstance(space, list) and space else str(space)
                n = {"DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4}.get(name, 1)
                if name == "ICCBased" and isinstance(icc := get(space[1]), Stream):
                    n = int(get(icc.dict.get("N")) or 1)
                state = set_color(op == "CS", [0.0] * (n - 1) + [1.0] if n == 4 else [0.0] * n, name)
            elif op in ("sc", "SC", "scn", "SCN"):
                named = str(args[-1]) if args and isinstance(args[-1], Name) else None
                state = set_color(op.isupper(), [a for a in args if isinstance(a, (int, float))], None, named)
            elif op in ("BMC", "BDC"):
                tag = next((str(a) for a in args if isinstance(a, Name)), "")
                props = args[-1] if op == "BDC" and args else None
                props = resource("Properties", props) if isinstance(props, Name) else props
                mcid = props.get("MCID") if isinstance(props, dict) else None
                marks.append((tag, int(mcid) if isinstance(mcid, (int, float)) else None))
            elif op == "EMC" and marks:
                marks.pop()
            elif op == "Do" and args:
                target = resource("XObject", args[-1])
                if isinstance(target, Stream):
                    kind = get(target.dict.get("Subtype"))
                    if kind == "Image":
                        self._image(str(args[-1]), target.dict, state, mark())
                    elif kind == "Form" and depth < MAX_FORMS and id(target) not in seen:
                        matrix = tuple(float(get(v)) for v in get(target.dict.get("Matrix")) or IDENTITY)
                        inner = get(target.dict.get("Resources"))
                        self.run(objects.bytes_of(target), inner if isinstance(inner, dict) else resources, multiply(matrix, state.ctm), depth + 1, (*seen, id(target)))
            elif op == "BI":
                d: dict = {}
                while isinstance(key := lexer.value(False), Name):
                    d[str(key)] = lexer.value(False)
                m = re.compile(rb"[\s]EI(?=[\s]|\Z)").search(data, lexer.at + 1)
                lexer.at = m.end() if m else len(data)
                long = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "IM": "ImageMask"}
                self._image("inline", {long.get(k, k): v for k, v in d.items()}, state, mark())
            args.clear()

    def _font(self, d) -> Font | None:
        if not isinstance(d, dict):
            return None
        if id(d) not in self.fonts:
            if all(type(v) in (Name, int, float) for v in d.values()):
                key = tuple(d.items())
                if key not in _PLAIN:
                    if len(_PLAIN) >= 256:
                        _PLAIN.clear()
                    _PLAIN[key] = Font(self.objects, d)
                self.fonts[id(d)] = _PLAIN[key]
            else:
                self.fonts[id(d)] = Font(self.objects, d)
        return self.fonts[id(d)]

    def _run(self, raw: bytes, s: State, tm: tuple, mark: dict) -> tuple:
        """_show for a font whose codes are single bytes: the places of all characters at once, summed up in their order."""
        codes = np.frombuffer(raw, np.uint8)
        adv = s.font.bytewise[0][codes] * s.size
        by = (adv + (np.where(codes == 32, s.char_space + s.word_space, s.char_space + 0) if s.word_space else s.char_space)) * s.scale
        ends = []
        for k in range(2):
            if k and not tm[1]:
                ends.append(np.full(len(codes) + 1, tm[5]))
                continue
            e = np.empty(len(codes) + 1)
            e[0] = tm[4 + k]
            np.multiply(by, tm[k], out=e[1:])
            ends.append(np.cumsum(e, out=e))
        self.shown.append((s, mark, tm[:4], codes, adv, ends[0][:-1], ends[1][:-1]))
        return (*tm[:4], float(ends[0][-1]), float(ends[1][-1]))

    def glyphs(self) -> list[Glyphs]:
        """The page's characters, where ``arrays`` was asked for."""
        out, k = [], 0
        while k < len(self.shown):
            first, last = self.shown[k], k + 1
            if isinstance(first, dict):
                alike = lambda r: isinstance(r, dict) and r["matrix"][:4] == first["matrix"][:4] and all(r[c] == first[c] for c in SHARED)  # noqa: B023, E731
            else:
                alike = lambda r: not isinstance(r, dict) and (r[0] is first[0] or r[0] == first[0]) and r[1:3] == first[1:3]  # noqa: B023, E731
            while last < len(self.shown) and alike(self.shown[last]):
                last += 1
            part = self.shown[k:last]
            out.append(Glyphs.of(part) if isinstance(first, dict) else self._place(first[0], first[1], first[2], *(np.concatenate(c) for c in list(zip(*part))[3:])))
            k = last
        return out

    def _place(self, s: State, mark: dict, tm: tuple, codes: np.ndarray, adv: np.ndarray, e: np.ndarray, f: np.ndarray) -> Glyphs:
        """Characters of one state and matrix, as _show and Page.place have them."""
        font, page = s.font, self.page
        m = multiply((*tm, 0.0, 0.0), s.ctm)
        e, f = e * s.ctm[0] + f * s.ctm[2] + s.ctm[4], e * s.ctm[1] + f * s.ctm[3] + s.ctm[5]
        wide, low, high = adv * s.scale, s.rise + font.descent * s.size, s.rise + (font.descent + 1) * s.size
        corners = [(m[0] * x + m[2] * y + e, m[1] * x + m[3] * y + f) for x in (0.0, wide) for y in (low, high)]
        bounds = [g(g(corners[0][k], corners[1][k]), g(corners[2][k], corners[3][k])) for k in range(2) for g in (np.minimum, np.maximum)]
        x0, x1, y0, y1 = bounds
        a, b, c, d = page.box
        left, right, top, bottom = {90: (y0 - b, y1 - b, x0 - a, x1 - a), 180: (c - x1, c - x0, y0 - b, y1 - b), 270: (d - y1, d - y0, c - x1, c - x0)}.get(page.rotate, (x0, x1, d - y1, d - y0))
        left, right, top, bottom = map(clean_all, (left, right, top, bottom))
        under, over = (clean_all(page.height - bottom), clean_all(page.height - top)) if page.rotate else (clean_all(y0), clean_all(y1))
        width, height = clean_all(right - left), clean_all(bottom - top)
        upright = m[0] * m[3] * s.scale > 0 and m[1] * m[2] <= 0
        columns = {"x0": left, "x1": right, "y0": under, "y1": over, "top": top, "bottom": bottom, "doctop": clean_all(top + page.offset), "width": width, "height": height, "size": height if upright else width, "adv": clean_all(wide), "e": clean_all(e), "f": clean_all(f)}
        shared = {"page_number": page.number} | mark | {"object_type": "char", "fontname": font.name, "upright": upright, "ncs": s.filling_space, "non_stroking_color": s.filling, "stroking_color": s.stroking}
        texts = font.bytewise[1]
        return Glyphs(shared, [clean(v) for v in m[:4]], [unicodedata.normalize(self.norm, t) for t in texts] if self.norm else texts, codes, columns)

    def _show(self, raw: bytes, s: State, tm: tuple, mark: dict) -> tuple:
        font, wanted = s.font, "chars" in self.kinds
        if wanted and self.arrays and font.kind != "Type0":
            numbers = (*tm, *s.ctm, s.size, s.char_space, s.word_space, s.scale, s.rise)
            if all(abs(v) < 1e9 for v in numbers):
                return self._run(raw, s, tm, mark) if raw else tm
        for code, n in font.codes(raw):
            adv = font.advance(code) * s.size
            m = multiply(tm, s.ctm)
            if wanted:
                text = font.text(code)
                text = unicodedata.normalize(self.norm, text) if self.norm else text
                if font.vertical:
                    box = [(-s.size / 2, s.rise + adv), (s.size / 2, s.rise)]
                else:
                    box = [(0.0, s.rise + font.descent * s.size), (adv * s.scale, s.rise + (font.descent + 1) * s.size)]
                corners = [apply(m, x, y) for x in (box[0][0], box[1][0]) for y in (box[0][1], box[1][1])]
                row = self.page.place(corners)
                upright = m[0] * m[3] * s.scale > 0 and m[1] * m[2] <= 0
                size = row["width"] if font.vertical or not upright else row["height"]
                (self.shown if self.arrays else self.chars).append(row | mark | {"object_type": "char", "text": text, "fontname": font.name, "size": size, "adv": clean(adv * s.scale if not font.vertical else adv), "upright": upright, "matrix": [clean(v) for v in m], "ncs": s.filling_space, "non_stroking_color": s.filling, "stroking_color": s.stroking})
            space = s.char_space + (s.word_space if code == 32 and n == 1 else 0)
            tm = multiply((1, 0, 0, 1, 0, adv - space) if font.vertical else (1, 0, 0, 1, (adv + space) * s.scale, 0), tm)
        return tm

    def _paint(self, path: list[tuple], s: State, stroke: bool, fill: bool, evenodd: bool, mark: dict) -> None:
        common = mark | {"linewidth": s.linewidth, "dash": {"pattern": s.dash[0], "phase": s.dash[1]} if s.dash else None, "fill": fill, "stroke": stroke, "evenodd": evenodd, "stroking_color": s.stroking, "non_stroking_color": s.filling}
        subpaths: list[list[tuple]] = []
        for step in path:
            if step[0] == "m" or not subpaths:
                subpaths.append([])
            subpaths[-1].append(step)
        for steps in subpaths:
            raw = [apply(s.ctm, *step[k : k + 2]) for step in steps for k in range(1, len(step), 2)]
            ends = [apply(s.ctm, *step[-2:]) for step in steps if len(step) > 1]
            if len(ends) < 2:
                continue
            closed, curved = steps[-1][0] == "h", any(x[0] == "c" for x in steps)
            kept = [{"cmd": x[0], "pts": [dict(zip("xy", map(clean, self.page.point(*apply(s.ctm, *x[k : k + 2]))))) for k in range(1, len(x), 2)]} for x in steps]

            def emit(kind, points, around):
                pts = [dict(zip("xy", map(clean, self.page.point(*p)))) for p in points]
                self.vectors.append(self.page.place(around) | common | {"object_type": kind, "pts": pts, "path": kept, "closepath": closed if kind == "curve" else None})

            unique = list(dict.fromkeys((clean(x), clean(y)) for x, y in ends))
            corners = ends[:-1] if len(ends) == 5 and ends[0] == ends[-1] else ends
            boxed = not curved and len(corners) == 4 and len(unique) == 4 and (closed or fill or len(ends) == 5) and self._axis_aligned(corners)
            if not curved and len(unique) == 2 and mark["tag"] != "P":
                emit("line", unique, ends)
            elif boxed:
                emit("rect", corners, ends)
            elif fill or closed or curved:
                emit("curve", ends, raw)
            else:
                for a, b in zip(ends, ends[1:]):
                    emit("line", [a, b], [a, b])

    @staticmethod
    def _axis_aligned(p: list[tuple[float, float]]) -> bool:
        same = lambda a, b: abs(a - b) < 1e-6
        across = all(same(p[i][i % 2 == 0], p[(i + 1) % 4][i % 2 == 0]) for i in range(4))
        down = all(same(p[i][i % 2], p[(i + 1) % 4][i % 2]) for i in range(4))
        return across or down

    def _image(self, name: str, d: dict, s: State, mark: dict) -> None:
        if "images" not in self.kinds:
            return
        get = self.objects.get
        corners = [apply(s.ctm, x, y) for x in (0, 1) for y in (0, 1)]
        space = get(d.get("ColorSpace"))
        space = "[" + ", ".join(str(get(x)) for x in space if not isinstance(get(x), (Stream, bytes))) + "]" if isinstance(space, list) else str(space) if space else None
        size = [float(get(d.get(k)) or 0) for k in ("Width", "Height")]
        self.images.append(self.page.place(corners) | mark | {"object_type": "image", "name": name, "srcsize": size, "colorspace": space, "bits": get(d.get("BitsPerComponent")), "imagemask": bool(get(d.get("ImageMask")))})
