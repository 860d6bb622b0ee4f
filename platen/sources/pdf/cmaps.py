"""Texts of codes from predefined CMaps and from the character maps of embedded TrueType fonts."""

from __future__ import annotations

import re

import numpy as np

from .errors import MOST_CODES, within

# Names of predefined CMaps, without the writing mode, and the codecs of their codes.
_CODECS = (
    (r"Uni.*-UTF8", "utf-8"), (r"Uni.*-UTF16", "utf-16-be"), (r"Uni.*-UTF32", "utf-32-be"), (r"Uni.*-UCS2(-HW)?", "utf-16-be"),
    (r"", "jis"), (r"(Ext|Add|NWP)", "jis"), (r"EUC", "euc_jp"), (r"(83pv|90ms|90msp|90pv|Add|Ext)-RKSJ", "cp932"),
    (r"(GBK-EUC|GBKp-EUC)", "gbk"), (r"GBK2K", "gb18030"), (r"(GB-EUC|GBpc-EUC)", "gb2312"), (r"(B5pc|ETen-B5|ETenms-B5)", "cp950"), (r"HKscs-B5", "big5hkscs"),
    (r"(KSC-EUC|KSCpc-EUC)", "euc_kr"), (r"KSCms-UHC(-HW)?", "cp949"),
)

def codec_of(name: str) -> str | None:
    """The codec of a predefined CMap; None for Identity and unknown names."""
    m = re.fullmatch(r"(?:(.*)-)?[HV]", name)
    return next((codec for pattern, codec in _CODECS if re.fullmatch(pattern, m[1] or "")), None) if m else None


def code_length(codec: str, raw: bytes) -> int:
    """Bytes of the code that ``raw`` starts with."""
    first = raw[0]
    if codec == "jis":
        return 2
    if codec == "utf-16-be":
        return 4 if 0xD8 <= first < 0xDC else 2
    if codec == "utf-32-be":
        return 4
    if codec == "utf-8":
        return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    if codec == "gb18030" and first >= 0x81 and len(raw) > 1 and 0x30 <= raw[1] <= 0x39:
        return 4
    single = first <= 0x80 or first == 0xFF or (codec == "cp932" and 0xA0 <= first < 0xE0)
    return 1 if single else 2


def decode_code(codec: str, raw: bytes) -> str | None:
    if codec == "jis":
        codec, raw = "euc_jp", bytes(c | 0x80 for c in raw)
    try:
        text = raw.decode(codec)
    except UnicodeDecodeError:
        return None
    return text if len(text) == 1 else None


def _table(data: bytes, tag: bytes) -> bytes:
    """A table of a font file, or nothing."""
    for k in range(int.from_bytes(data[4:6], "big")):
        entry = data[12 + 16 * k : 28 + 16 * k]
        if entry[:4] == tag and len(entry) == 16:
            at, size = int.from_bytes(entry[8:12], "big"), int.from_bytes(entry[12:], "big")
            return data[at : at + size]
    return b""


def _segments(sub: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Characters and their glyphs of a map of format 4 (16-bit segments)."""
    words = np.frombuffer(sub[: len(sub) // 2 * 2], ">u2").astype(np.int64)
    n = int(words[3]) // 2
    ends, starts, deltas, offsets = (words[k : k + n] for k in (7, 8 + n, 8 + 2 * n, 8 + 3 * n))
    n = min(map(len, (ends, starts, deltas, offsets)))
    sizes = np.maximum(ends[:n] - starts[:n] + 1, 0)
    segment = np.repeat(np.arange(n), sizes)
    chars = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[segment]
    # an offset counts bytes from its own place; without one the glyph is the character plus the delta
    place = 8 + 3 * int(words[3] // 2) + segment + offsets[segment] // 2 + chars - starts[segment]
    inside = place < len(words)
    listed = np.where(inside, words[np.where(inside, place, 0)], 0)
    glyphs = np.where(offsets[segment] == 0, chars + deltas[segment], np.where(listed == 0, 0, listed + deltas[segment])) & 0xFFFF
    return chars, np.where(chars == 0xFFFF, 0, glyphs)


def _groups(sub: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Characters and their glyphs of a map of format 12 (groups of characters)."""
    count = int.from_bytes(sub[12:16], "big")
    rows = np.frombuffer(sub[16 : 16 + (len(sub) - 16) // 12 * 12], ">u4").reshape(-1, 3)[:count].astype(np.int64)
    rows = rows[(rows[:, 1] >= rows[:, 0]) & (rows[:, 1] < 0x110000)]
    sizes = rows[:, 1] - rows[:, 0] + 1
    within(int(sizes.sum()), 2 * MOST_CODES, "characters of a font's map")
    step = np.arange(int(sizes.sum())) if len(rows) else np.empty(0, np.int64)
    row = np.searchsorted(np.cumsum(sizes), step, side="right")
    step = step - (np.cumsum(sizes) - sizes)[row]
    return rows[row, 0] + step, rows[row, 2] + step


def glyph_texts(font: bytes) -> dict[int, str]:
    """Glyph to text by the best Unicode map of a TrueType file: the full one, then that of the basic plane, then any
    other; the smallest character of a glyph names it. Nothing if there is no such map."""
    cmap = _table(font, b"cmap")
    found = []
    for k in range(int.from_bytes(cmap[2:4], "big")):
        entry = cmap[4 + 8 * k : 12 + 8 * k]
        platform, kind, at = (int.from_bytes(entry[i:j], "big") for i, j in ((0, 2), (2, 4), (4, 8)))
        form = int.from_bytes(cmap[at : at + 2], "big")
        if len(entry) == 8 and form in (4, 12):
            rank = {(3, 10): 0, (3, 1): 1}.get((platform, kind), 2 if platform == 0 else 3)
            found.append((rank, form != 12, k, at))
    for _, short, _, at in sorted(found):
        try:
            chars, glyphs = _segments(cmap[at:]) if short else _groups(cmap[at:])
        except (IndexError, ValueError):
            continue
        sound = (glyphs > 0) & ((chars < 0xD800) | (chars > 0xDFFF))
        glyphs, first = np.unique(glyphs[sound], return_index=True)
        if len(glyphs):
            return {g: chr(c) for g, c in zip(glyphs.tolist(), chars[sound][first].tolist())}
    return {}
