"""The decoder's error, and the bounds beyond which it is raised."""

from __future__ import annotations

#: Bytes that one stream may unpack to, and codes or glyphs that one map may name: all of Unicode.
MOST_BYTES, MOST_CODES = 1 << 28, 0x110000


class PdfError(Exception):
    """An error with the name that callers see."""

    def __init__(self, name: str, message: str):
        super().__init__(message)
        self.name = name


def within(size: int, most: int, what: str) -> None:
    """Raises where a bound is passed: nothing is ever cut to it."""
    if size > most:
        raise PdfError("BoundExceededException", f"{what} over {most}")
