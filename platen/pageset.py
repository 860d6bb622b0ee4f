"""A fluent handle on the pages of many documents: open, crop, filter, and extract, all lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boxes, edges, layout, tables, text
from .operators.words import WordOptions, extract_words
from .schema import PAGE
from .sources import reader


OBJECTS = ("chars", "vectors", "images", "annots")


@dataclass(frozen=True)
class PageSet:
    """Pages and the objects on them; every operation gives a new set."""

    pages: DataFrame
    chars: DataFrame
    vectors: DataFrame
    images: DataFrame
    annots: DataFrame
    documents: DataFrame | None = None
    #: All kinds in one pass over the files, as long as nothing has changed them.
    raw: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, source, pages: list[int] | None = None, password: str = "", unicode_norm: str | None = None, mode: str = "PERMISSIVE", max_bytes: int | None = None, store: str | None = None) -> "PageSet":
        """``source``: a path or paths that Spark reads, URLs, bytes by id, or a DataFrame (doc_id, path, content).

        With ``store``, a folder, the files are decoded once, all kinds in one pass, and read from there; else each kind is
        decoded when it is used, and then without building the others.
        """
        if isinstance(source, DataFrame):
            files = source
        elif isinstance(source, dict):
            files = reader.from_bytes(spark, source)
        elif isinstance(source, (bytes, bytearray)):
            files = reader.from_bytes(spark, {0: bytes(source)})
        elif (listed := [source] if isinstance(source, str) else list(source)) and listed[0].startswith(("http://", "https://")):
            files = reader.fetch(spark, listed)
        else:
            files = reader.files(spark, listed, max_bytes)
        raw = reader.decode_kinds(files, tuple(reader.SCHEMAS), pages, password, unicode_norm, mode)
        if store:
            raw.write.partitionBy("kind").parquet(store)
            raw = spark.read.schema(raw.schema).parquet(store)
            return cls(**{k: reader.of_kind(raw, k) for k in reader.SCHEMAS}, raw=raw)
        return cls(**{k: reader.decode(files, k, pages, password, unicode_norm, mode) for k in reader.SCHEMAS}, raw=raw)

    def _each(self, f) -> "PageSet":
        return replace(self, raw=None, **{k: f(getattr(self, k)) for k in OBJECTS})

    def _box(self, box: tuple, relative: bool, strict: bool) -> DataFrame:
        """Pages with the wanted box; strict ones check it against each page's own when rows are made."""
        given = F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(box, ("x0", "top", "x1", "bottom"))))
        boxes.check_box(box)
        b = lambda n: F.col(f"bbox.{n}")
        if relative:
            given = F.struct(*((F.lit(float(v)) + b("x0" if n[0] == "x" else "top")).alias(n) for v, n in zip(box, ("x0", "top", "x1", "bottom"))))
        out = self.pages.withColumn("__to", given)
        if strict:
            to = lambda n: F.col(f"__to.{n}")
            inside = (to("x0") >= b("x0")) & (to("top") >= b("top")) & (to("x1") <= b("x1")) & (to("bottom") <= b("bottom"))
            out = out.withColumn("__to", F.when(inside, F.col("__to")).otherwise(F.raise_error(F.lit(f"bounding box {box} is not fully within its page"))))
        return out

    def _on_pages(self, box: tuple, relative: bool, strict: bool, f, new_box: bool) -> "PageSet":
        pages = self._box(box, relative, strict)
        keys = pages.select(*PAGE, *(F.col(f"__to.{n}").alias(f"__{n}") for n in ("x0", "top", "x1", "bottom")))

        def one(df: DataFrame) -> DataFrame:
            return f(df.join(keys, PAGE), ("__x0", "__top", "__x1", "__bottom")).drop("__x0", "__top", "__x1", "__bottom")

        out = self._each(one)
        return replace(out, pages=pages.withColumn("bbox", F.col("__to")).drop("__to") if new_box else self.pages)

    def crop(self, bbox: tuple, relative: bool = False, strict: bool = True) -> "PageSet":
        return self._on_pages(bbox, relative, strict, boxes.crop, True)

    def within_bbox(self, bbox: tuple, relative: bool = False, strict: bool = True) -> "PageSet":
        return self._on_pages(bbox, relative, strict, boxes.within, True)

    def outside_bbox(self, bbox: tuple, relative: bool = False, strict: bool = True) -> "PageSet":
        return self._on_pages(bbox, relative, strict, boxes.outside, False)

    def filter(self, predicate: Column | Callable[[dict], bool]) -> "PageSet":
        """Keeps what fulfils the predicate: a column, with null for columns that a kind lacks, or a function of the object
        as a dict of its own columns (in Python, batch by batch)."""
        every = {f.name: f.dataType for k in OBJECTS for f in getattr(self, k).schema}

        def by_column(df: DataFrame) -> DataFrame:
            wide = df.select("*", *(F.lit(None).cast(t).alias(n) for n, t in every.items() if n not in df.columns))
            return wide.filter(predicate).select(*df.columns)

        def by_function(df: DataFrame) -> DataFrame:
            def run(batches):
                for batch in batches:
                    yield batch.filter(pa.array([bool(predicate(row)) for row in batch.to_pylist()], pa.bool_()))

            return df.mapInArrow(run, df.schema)

        return self._each(by_column if isinstance(predicate, Column) else by_function)

    def dedupe_chars(self, tolerance: float = 1, extra_attrs: tuple = ("fontname", "size")) -> "PageSet":
        return replace(self, raw=None, chars=boxes.dedupe(self.chars, tolerance, extra_attrs))

    @property
    def edges(self) -> DataFrame:
        return edges.page_edges(self.vectors)

    @property
    def horizontal_edges(self) -> DataFrame:
        return self.edges.filter("orientation = 'h'")

    @property
    def vertical_edges(self) -> DataFrame:
        return self.edges.filter("orientation = 'v'")

    @property
    def hyperlinks(self) -> DataFrame:
        return self.annots.filter("uri IS NOT NULL")

    @property
    def objects(self) -> DataFrame:
        if self.raw is not None:  # one pass over the files
            types = {f.name: f.dataType for k in OBJECTS for f in getattr(self, k).schema}
            have = {k: getattr(self, k).columns for k in OBJECTS}
            columns = [F.coalesce(*(F.col(f"{k}.{n}").cast(t) for k in OBJECTS if n in have[k])).alias(n) for n, t in types.items()]
            return self.raw.filter(F.col("kind").isin(*OBJECTS)).select(*columns)
        out = self.chars
        for k in OBJECTS[1:]:
            out = out.unionByName(getattr(self, k), allowMissingColumns=True)
        return out

    def extract_words(self, return_chars: bool = False, limit: int | None = None, slice: tuple | None = None, **options) -> DataFrame:
        return extract_words(self.chars, WordOptions(**options), return_chars, limit, slice)

    def extract_text(self, **options) -> DataFrame:
        names = set(text.TextOptions.__dataclass_fields__) - {"words"}
        own = {k: v for k, v in options.items() if k in names}
        return text.extract_text(self.chars, text.TextOptions(WordOptions(**{k: v for k, v in options.items() if k not in names}), **own), self.pages)

    def extract_text_lines(self, strip: bool = True, return_chars: bool = True, **options) -> DataFrame:
        return text.extract_text_lines(self.chars, strip, return_chars, WordOptions(**options))

    def search(self, pattern, regex: bool = True, case: bool = True, main_group: int = 0, return_groups: bool = True, return_chars: bool = True, **options) -> DataFrame:
        return text.search(self.chars, pattern, regex, case, main_group, return_groups, return_chars, WordOptions(**options))

    def find_tables(self, **settings) -> DataFrame:
        return tables.find_tables(self.vectors, self.chars, self.pages, tables.TableSettings.resolve(**settings))

    def find_table(self, **settings) -> DataFrame:
        return tables.largest_table(self.find_tables(**settings))

    def extract_tables(self, **settings) -> DataFrame:
        return tables.extract_tables(self.chars, self.find_tables(**settings), tables.TableSettings.resolve(**settings).text)

    def extract_table(self, **settings) -> DataFrame:
        return tables.extract_tables(self.chars, self.find_table(**settings), tables.TableSettings.resolve(**settings).text)

    def layout(self, **params) -> DataFrame:
        return layout.analyse(self.chars, layout.LayoutParams(**params))

    def write(self, path: str) -> None:
        """All objects as Parquet, by object type."""
        self.objects.write.partitionBy("object_type").parquet(path)

    # the same operations under camelCase names
    withinBBox, outsideBBox, dedupeChars, extractWords, extractText = within_bbox, outside_bbox, dedupe_chars, extract_words, extract_text
    extractTextLines, findTables, findTable, extractTables, extractTable = extract_text_lines, find_tables, find_table, extract_tables, extract_table
