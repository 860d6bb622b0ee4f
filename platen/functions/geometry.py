"""Column expressions on boxes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ("ltr", "rtl", "ttb", "btt")


def clean(x: Column | str) -> Column:
    """Six decimals, ties to even, and no negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.bround(x, 6) + F.lit(0.0)


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(x + 0.5)


def overlap(box: tuple, other: tuple = ("x0", "top", "x1", "bottom")) -> Column:
    """Whether two boxes (x0, top, x1, bottom; columns, names or numbers) overlap; an edge in common counts, a corner
    does not."""
    a, b = ([F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in x] for x in (box, other))
    left, top = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, bottom = F.least(a[2], b[2]), F.least(a[3], b[3])
    return (right >= left) & (bottom >= top) & ((bottom - top) + (right - left) > 0)


def holds_midpoint(box: tuple[Column, ...]) -> Column:
    """Whether the row's middle lies in the box, whose right and lower sides are outside."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])


def line_key(direction: str) -> Column:
    return {"ttb": F.col("top"), "btt": -F.col("bottom"), "ltr": F.col("x0"), "rtl": -F.col("x1")}[direction]


def char_key(direction: str) -> tuple[Column, Column]:
    return {
        "ttb": (F.col("top"), F.col("bottom")), "btt": (-(F.col("top") + F.col("height")), -F.col("top")),
        "ltr": (F.col("x0"), F.col("x0")), "rtl": (-F.col("x1"), -F.col("x0")),
    }[direction]


def check_directions(line: str, char: str) -> None:
    if line not in DIRECTIONS or char not in DIRECTIONS:
        raise ValueError(f"unknown text directions: {line}, {char}")
    if (line in ("ttb", "btt")) == (char in ("ttb", "btt")):
        raise ValueError(f"text directions along one axis: {line}, {char}")


def shorten(x: Column | str, size: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    if size < 7:
        return F.substring(x, 1, size)
    half = (size - 5) // 2
    return F.when(F.length(x) <= size, x).otherwise(F.concat(F.substring(x, 1, half), F.lit(" ... "), F.right(x, F.lit(half))))


def roman(x: Column | str) -> Column:
    """1 to 3999 in lower-case Roman numerals."""
    x = F.col(x) if isinstance(x, str) else x
    tens = [("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm")]
    parts = [F.get(F.array(*map(F.lit, digits)), (F.floor(x / 10**k) % 10).cast("int")) for k, digits in enumerate(tens)]
    return F.concat(*reversed(parts))


def alpha(x: Column | str) -> Column:
    """1 is a, 26 z, 27 aa and so on (up to six letters)."""
    x = (F.col(x) if isinstance(x, str) else x).cast("long")
    out, rest = F.lit(""), x
    for _ in range(6):
        letter = F.chr(97 + (rest - 1) % 26)
        out = F.when(rest > 0, F.concat(letter, out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(rest)
    return out
