"""Words from characters: runs, lines and gaps, all as windows over one partitioning by page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import char_key, check_directions, clean, line_key
from ..schema import PAGE
from .boxes import slice_rows
from .cluster import with_cluster, with_runs

# Ligatures and ASCII punctuation; white space as JavaScript and Unicode have it.
LIGATURES = {"ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬁ": "fi", "ﬂ": "fl", "ﬆ": "st", "ﬅ": "st"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANK = "^[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]$"


@dataclass(frozen=True)
class WordOptions:
    x_tolerance: float = 3
    y_tolerance: float = 3
    x_tolerance_ratio: float | None = None
    y_tolerance_ratio: float | None = None
    keep_blank_chars: bool = False
    use_text_flow: bool = False
    horizontal_ltr: bool = True
    vertical_ttb: bool = True
    line_dir: str = "ttb"
    char_dir: str = "ltr"
    line_dir_rotated: str | None = None
    char_dir_rotated: str | None = None
    extra_attrs: tuple[str, ...] = ()
    split_at_punctuation: bool | str = False
    expand_ligatures: bool = True

    def __post_init__(self):
        check_directions(self.line_dir, self.char_dir)
        check_directions(self.line_dir_rotated or self.char_dir, self.char_dir_rotated or self.line_dir)

    def lines(self, upright: bool) -> str:
        return self.line_dir if upright else self.line_dir_rotated or self.char_dir

    def chars(self, upright: bool) -> str:
        if not upright and not self.vertical_ttb:
            return "btt"
        if upright and not self.horizontal_ltr:
            return "rtl"
        return self.char_dir if upright else self.char_dir_rotated or self.line_dir

    @property
    def punctuation(self) -> str:
        return PUNCTUATION if self.split_at_punctuation is True else self.split_at_punctuation or ""


def expand(text: Column, on: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in LIGATURES.items() for x in p]), text), text) if on else text


def _either(on_upright: Column, on_rotated: Column) -> Column:
    return F.when(F.col("upright"), on_upright).otherwise(on_rotated)


def _breaks(direction: str, x: Column, y: Column, over) -> Column:
    """Whether the row begins a new word after the one before it."""
    before = lambda c: F.lag(c).over(over)
    if direction in ("ltr", "rtl"):
        along, across, slack, level = ("x0", "x1"), "top", x, y
    else:
        along, across, slack, level = ("top", "bottom"), "x0", y, x
    if direction in ("ltr", "ttb"):
        a, b, c = before(along[0]), before(along[1]), F.col(along[0])
    else:
        a, b, c = -before(along[1]), -before(along[0]), -F.col(along[1])
    return (c < a) | (c > b + slack) | (F.abs(F.col(across) - before(across)) > level)


def word_chars(chars: DataFrame, o: WordOptions = WordOptions()) -> DataFrame:
    """Characters that are in words, with run, line, word (numbers in the page's word order) and place, in the word."""
    df = chars.repartition(*PAGE)
    parts = [F.col("upright"), *(clean(a) if dict(chars.dtypes)[a] == "double" else F.col(a) for a in o.extra_attrs)]
    df = with_runs(df, F.struct(*parts), ["seq"])
    by = [*PAGE, "run"]
    if o.use_text_flow:
        df = df.withColumn("line", F.lit(0))
        order: list = ["seq"]
        ways = (o.char_dir, o.char_dir)
    else:
        key = _either(line_key(o.lines(True)), line_key(o.lines(False)))
        slack = [float(o.y_tolerance if o.lines(u) in ("ttb", "btt") else o.x_tolerance) for u in (True, False)]
        df = with_cluster(df, key, _either(F.lit(slack[0]), F.lit(slack[1])), by, "line")
        ways = (o.chars(True), o.chars(False))
        keys = [char_key(w) for w in ways]
        # as columns, so that all windows name the same ones and share one sort
        df = df.withColumns({f"__o{k}": _either(keys[0][k], keys[1][k]) for k in range(2)})
        order = ["__o0", "__o1", "seq"]
    over = Window.partitionBy(*by, "line").orderBy(*order)
    size = F.lag("size").over(over)
    x = F.lit(float(o.x_tolerance)) if o.x_tolerance_ratio is None else o.x_tolerance_ratio * size
    y = F.lit(float(o.y_tolerance)) if o.y_tolerance_ratio is None else o.y_tolerance_ratio * size
    text = F.coalesce("text", F.lit(""))
    blank = F.lit(False) if o.keep_blank_chars else text.rlike(BLANK)
    alone = ~blank & (F.lit(o.punctuation).contains(text) if o.punctuation else text == "")
    alone |= text == ""
    df = df.withColumn("__blank", blank).withColumn("__alone", alone)
    apart = _breaks(ways[0], x, y, over) if ways[0] == ways[1] else _either(_breaks(ways[0], x, y, over), _breaks(ways[1], x, y, over))
    new = F.lag("__blank", 1, True).over(over) | F.col("__alone") | F.lag("__alone", 1, False).over(over) | F.coalesce(apart, F.lit(True))
    df = df.withColumn("__new", (new & ~F.col("__blank")).cast("int")).withColumn("place", F.row_number().over(over))
    # one order serves both windows: the page's words are numbered along lines and runs
    page = Window.partitionBy(*PAGE).orderBy("run", "line", *order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("word_seq", F.sum("__new").over(page) - 1).filter("NOT __blank")
    direction = _either(F.lit(o.chars(True)), F.lit(o.chars(False)))
    return df.withColumn("direction", direction).drop("__blank", "__alone", "__new", "__o0", "__o1")


def extract_words(chars: DataFrame, o: WordOptions = WordOptions(), return_chars: bool = False, limit: int | None = None, slice: tuple | None = None) -> DataFrame:
    """One row per word: word_seq, text, box, doctop, upright, direction, the first character's extra attributes."""
    df = word_chars(chars, o)
    first = lambda c: F.min_by(c, "place")
    pieces = F.array_sort(F.collect_list(F.struct("place", expand(F.col("text"), o.expand_ligatures).alias("text"))))
    out = df.groupBy(*PAGE, "word_seq").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        first(F.col("doctop") - F.col("top")).alias("__down"), first("upright").alias("upright"), first("direction").alias("direction"),
        *(first(a).alias(a) for a in o.extra_attrs),
        *([F.array_sort(F.collect_list(F.struct("place", "seq", "x0", "top", "x1", "bottom", "text"))).alias("chars")] if return_chars else []),
    )
    names = ["upright", "direction", *o.extra_attrs, *(["chars"] if return_chars else [])]
    out = out.select(*PAGE, "word_seq", "text", *(clean(c).alias(c) for c in ("x0", "x1", "top", "bottom")), clean(F.col("top") + F.col("__down")).alias("doctop"), clean(F.col("x1") - F.col("x0")).alias("width"), clean(F.col("bottom") - F.col("top")).alias("height"), *names)
    if slice or limit is not None:
        out = slice_rows(out, *(slice or ()), limit=limit, order="word_seq")
    return out
