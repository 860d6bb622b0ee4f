"""Fonts: from codes to texts, widths and metrics."""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property

import numpy as np

from .cmaps import code_length, codec_of, decode_code, glyph_texts
from .errors import MOST_CODES, within
from .objects import Lexer, Name, Objects, Stream

# Glyph names that are not letters with accents, by their characters.
_PUNCTUATION = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’",
    "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡",
    "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "guillemotleft": "«", "guillemotright": "»", "exclamdown": "¡", "questiondown": "¿", "cent": "¢", "sterling": "£",
    "currency": "¤", "yen": "¥", "Euro": "€", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "registered": "®", "trademark": "™", "ordfeminine": "ª", "ordmasculine": "º",
    "logicalnot": "¬", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "onequarter": "¼", "onehalf": "½",
    "threequarters": "¾", "multiply": "×", "divide": "÷", "minus": "−", "florin": "ƒ", "fraction": "⁄", "circumflex": "ˆ", "tilde": "˜", "breve": "˘", "dotaccent": "˙", "ring": "˚",
    "ogonek": "˛", "caron": "ˇ", "hungarumlaut": "˝", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "germandbls": "ß", "dotlessi": "ı",
    "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "nbspace": " ", "sfthyphen": "­", "notequal": "≠", "lessequal": "≤",
    "greaterequal": "≥", "infinity": "∞", "partialdiff": "∂", "summation": "∑", "product": "∏", "pi": "π", "integral": "∫", "Omega": "Ω", "radical": "√", "approxequal": "≈", "Delta": "∆", "lozenge": "◊",
}
# Accents in glyph names and in Unicode names.
_ACCENTS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "caron": "CARON", "cedilla": "CEDILLA", "ogonek": "OGONEK", "macron": "MACRON", "breve": "BREVE", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "commaaccent": "CEDILLA"}
# Where the standard encoding differs from ASCII, and its upper half from code 161.
_STANDARD = {39: "quoteright", 96: "quoteleft"} | dict(enumerate("exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl".split(), 161)) | {177: "endash", 178: "dagger", 179: "daggerdbl", 180: "periodcentered", 182: "paragraph", 183: "bullet", 184: "quotesinglbase", 185: "quotedblbase", 186: "quotedblright", 187: "guillemotright", 188: "ellipsis", 189: "perthousand", 191: "questiondown"} | dict(enumerate("grave acute circumflex tilde macron breve dotaccent dieresis".split(), 193)) | {202: "ring", 203: "cedilla", 205: "hungarumlaut", 206: "ogonek", 207: "caron", 208: "emdash", 225: "AE", 227: "ordfeminine", 232: "Lslash", 233: "Oslash", 234: "OE", 235: "ordmasculine", 241: "ae", 245: "dotlessi", 248: "lslash", 249: "oslash", 250: "oe", 251: "germandbls"}
# Widths of codes 32 to 126 of Helvetica and Times, and ascents and descents of the standard families.
_HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
_TIMES = "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
_METRICS = {"Courier": (0.627, -0.194), "Helvetica": (0.718, -0.207), "Times": (0.683, -0.217)}
_FAMILIES = (("Courier", "Courier"), ("Helvetica", "Helvetica"), ("Arial", "Helvetica"), ("Times", "Times"))
ASCENT, DESCENT = 0.8, -0.2


def glyph_text(name: str) -> str | None:
    """The text of a glyph name."""
    base = name.split(".", 1)[0]
    if base in _PUNCTUATION:
        return _PUNCTUATION[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    if base[0].isalpha() and base[1:] in _ACCENTS:
        try:
            return unicodedata.lookup(f"LATIN {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {base[0].upper()} WITH {_ACCENTS[base[1:]]}")
        except KeyError:
            return None
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {base.upper()}")
    except KeyError:
        return None


def _codepage(name: str) -> list[str | None]:
    return [bytes([i]).decode(name, "ignore") or None for i in range(256)]


def encoding(name: str | None) -> list[str | None]:
    if name == "MacRomanEncoding":
        return _codepage("mac_roman")
    if name == "WinAnsiEncoding":
        table = _codepage("cp1252")
        return [t or ("•" if i > 126 else None) for i, t in enumerate(table)]
    table: list[str | None] = [chr(i) if 32 <= i < 127 else None for i in range(256)]
    for i, glyph in _STANDARD.items():
        table[i] = glyph_text(glyph)
    return table


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "ignore")


def parse_cmap(data: bytes) -> tuple[dict[int, str], list[tuple[int, int, int]]]:
    """Texts by code and code space ranges (bytes, low, high) of a ToUnicode CMap."""
    lexer, texts, spaces, stack = Lexer(data), {}, [], []
    while True:
        within(len(texts), MOST_CODES, "codes of a character map")
        x = lexer.value(False)
        if not isinstance(x, str) or isinstance(x, Name):
            stack.append(x)
            continue
        if x == "" and lexer.at >= len(data):
            break
        number = lambda b: int.from_bytes(b, "big")
        if x == "endcodespacerange":
            for a, b in zip(stack[::2], stack[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes) and a:
                    spaces.append((len(a), number(a), number(b)))
        elif x == "endbfchar":
            for a, b in zip(stack[::2], stack[1::2]):
                if isinstance(a, bytes):
                    texts[number(a)] = _utf16(b) if isinstance(b, bytes) else glyph_text(str(b)) or ""
        elif x == "endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                low, high = number(a), min(number(b), number(a) + 0xFFFF)
                for k in range(high - low + 1):
                    if isinstance(c, list):
                        if k < len(c) and isinstance(c[k], bytes):
                            texts[low + k] = _utf16(c[k])
                    elif isinstance(c, bytes) and c:
                        texts[low + k] = _utf16(c[:-2] + ((number(c[-2:]) + k) & 0xFFFF).to_bytes(min(2, len(c)), "big")) if len(c) > 1 else chr(c[0] + k)
        stack = []
    return texts, spaces


class Font:
    """One font resource."""

    def __init__(self, objects: Objects, d: dict):
        get = objects.get
        self.kind = str(get(d.get("Subtype")) or "Type1")
        base = str(get(d.get("BaseFont")) or get(d.get("Name")) or "unknown")
        self.name = base
        family = next((f for start, f in _FAMILIES if base.split("+")[-1].startswith(start)), None)
        descendant = get((get(d.get("DescendantFonts")) or [None])[0]) if self.kind == "Type0" else None
        descriptor = get((descendant or d).get("FontDescriptor")) or {}
        self.matrix = [float(get(x)) for x in get(d.get("FontMatrix")) or (0.001, 0, 0, 0.001, 0, 0)] if self.kind == "Type3" else (0.001, 0, 0, 0.001, 0, 0)
        ascent, descent = get(descriptor.get("Ascent")), get(descriptor.get("Descent"))
        standard = _METRICS.get(family, (ASCENT, DESCENT))
        self.ascent = ascent / 1000 if isinstance(ascent, (int, float)) and ascent else standard[0]
        self.descent = -abs(descent) / 1000 if isinstance(descent, (int, float)) and descent else standard[1]
        if self.kind == "Type3" and (box := get(d.get("FontBBox"))) and len(box) == 4:
            self.descent, self.ascent = float(get(box[1])) * self.matrix[3], float(get(box[3])) * self.matrix[3]
        coding = get(d.get("Encoding"))
        self.vertical = self.kind == "Type0" and isinstance(coding, str) and coding.endswith("V")
        self.codec = codec_of(str(coding)) if self.kind == "Type0" and isinstance(coding, str) else None
        self.texts: dict[int, str] = {}
        self.spaces: list[tuple[int, int, int]] = []
        if isinstance(unicode := get(d.get("ToUnicode")), Stream):
            self.texts, self.spaces = parse_cmap(objects.bytes_of(unicode))
        self.widths: dict[int, float] = {}
        if self.kind == "Type0":
            self.default = float(get((descendant or {}).get("DW")) or 1000)
            self._wide(get((descendant or {}).get("W")) or [], get)
            self.table: list[str | None] = []
            if not isinstance(unicode, Stream) and not self.codec and isinstance(file := get(descriptor.get("FontFile2")), Stream):
                self._embedded(glyph_texts(objects.bytes_of(file)), get((descendant or {}).get("CIDToGIDMap")), objects)
            return
        first = int(get(d.get("FirstChar")) or 0)
        for k, w in enumerate(get(d.get("Widths")) or []):
            if isinstance(width := get(w), (int, float)):
                self.widths[first + k] = float(width)
        missing = get(descriptor.get("MissingWidth"))
        self.default = float(missing) if isinstance(missing, (int, float)) else 0.0
        name = str(coding) if isinstance(coding, str) else str(get((coding or {}).get("BaseEncoding")) or "")
        self.table = encoding(name or None)
        if isinstance(coding, dict):
            at = 0
            for x in get(coding.get("Differences")) or []:
                x = get(x)
                if isinstance(x, (int, float)) and not isinstance(x, bool):
                    at = int(x)
                elif isinstance(x, Name) and at < 256:
                    self.table[at] = glyph_text(x)
                    at += 1
        if not self.widths:
            if family == "Courier":
                self.default = 600.0
            else:
                values = (_TIMES if family == "Times" else _HELVETICA).split()
                plain = {chr(32 + k): float(w) for k, w in enumerate(values)}
                for code, text in enumerate(self.table):
                    if text:
                        self.widths[code] = plain.get(unicodedata.normalize("NFD", text)[0], 556.0)

    def _embedded(self, glyphs: dict[int, str], placed, objects: Objects) -> None:
        """Texts of codes, which are glyphs or lead to them, but those of private characters."""
        if isinstance(placed, Stream):
            raw = objects.bytes_of(placed)
            codes = {k // 2: int.from_bytes(raw[k : k + 2], "big") for k in range(0, min(len(raw), 2 * 0x10000) - 1, 2)}
            glyphs = {code: glyphs[g] for code, g in codes.items() if g in glyphs}
        self.texts = {code: text for code, text in glyphs.items() if unicodedata.category(text) != "Co"}

    def _wide(self, rows: list, get) -> None:
        at = 0
        while at < len(rows):
            within(len(self.widths), MOST_CODES, "widths of a font")
            first, second = get(rows[at]), get(rows[at + 1]) if at + 1 < len(rows) else None
            if isinstance(second, list):
                self.widths |= {int(first) + k: float(get(w)) for k, w in enumerate(second)}
                at += 2
            elif at + 2 < len(rows):
                self.widths |= dict.fromkeys(range(int(first), min(int(second), int(first) + 0xFFFF) + 1), float(get(rows[at + 2])))
                at += 3
            else:
                break

    @cached_property
    def bytewise(self) -> tuple[np.ndarray, list[str]]:
        """Advances and texts by code, of a font whose codes are single bytes."""
        return np.array([self.advance(c) for c in range(256)], dtype=float), [self.text(c) for c in range(256)]

    def codes(self, raw: bytes):
        """(code, bytes) of a shown string."""
        if self.kind != "Type0":
            yield from ((c, 1) for c in raw)
            return
        at = 0
        while at < len(raw):
            if self.codec and not self.spaces:
                n = code_length(self.codec, raw[at : at + 4])
                yield int.from_bytes(raw[at : at + n], "big"), n
                at += n
                continue
            n = next((n for n, low, high in self.spaces if low <= int.from_bytes(raw[at : at + n], "big") <= high and at + n <= len(raw)), 2)
            yield int.from_bytes(raw[at : at + n], "big"), n
            at += n

    def text(self, code: int) -> str:
        if code in self.texts:
            return self.texts[code]
        if self.codec:
            raw = code.to_bytes(max({"jis": 2, "utf-16-be": 2, "utf-32-be": 4}.get(self.codec, 1), (code.bit_length() + 7) // 8), "big")
            return decode_code(self.codec, raw) or f"(cid:{code})"
        found = self.table[code] if code < len(self.table) else None
        return found if found is not None else f"(cid:{code})"

    def advance(self, code: int) -> float:
        """In text space at size one."""
        if self.vertical:
            return -1.0
        if self.codec:  # widths go by CID: without the maps from codes, single bytes are half as wide as others
            return (self.default if code > 0xFF or self.codec.startswith("utf") else self.default / 2) * 0.001
        return self.widths.get(code, self.default) * (self.matrix[0] if self.kind == "Type3" else 0.001)
