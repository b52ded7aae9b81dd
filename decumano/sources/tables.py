"""Delimited text and SQLite files as tables."""

from __future__ import annotations

import csv
import io
import sqlite3
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .binary import files, parsed

#: Tables of spatial SQLite files that hold no data (prefixes).
SYSTEM_TABLES = ("sqlite_", "gpkg_", "rtree_", "spatial", "geometry_columns", "views_", "virts_", "idx_", "ElementaryGeometries", "KNN", "SpatialIndex", "layer_styles")


def sniff(head: bytes) -> tuple[str, str]:
    """(separator, encoding) of the first bytes of a text table: the separator that splits most lines alike."""
    for enc in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            text = head.decode(enc)
            break
        except UnicodeDecodeError as e:
            if enc == "utf-8-sig" and e.start >= len(head) - 3:
                text = head[: e.start].decode(enc)
                break
    lines = [ln for ln in text.splitlines()[:20] if ln.strip()]
    best, score = ",", 0.0
    for sep in ",;\t|":
        counts = Counter(ln.count(sep) for ln in lines)
        n, times = max(counts.items(), key=lambda kv: (kv[0] > 0, kv[1], kv[0]), default=(0, 0))
        if n and times * (1 + n / 100) > score:
            best, score = sep, times * (1 + n / 100)
    return best, {"utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}[enc]


def _single_byte(content: bytes) -> str:
    """cp1252, or Latin-1 where a byte has no meaning in it."""
    try:
        return content.decode("cp1252")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def read_table(spark: SparkSession, path: str, head_bytes: int = 65536) -> DataFrame:
    """A delimited file with sniffed separator and encoding, all columns as text.

    The separator is that of the first lines; whether the file is UTF-8 is decided on all of it. UTF-8 and Latin-1 go to the engine's reader. It takes no cp1252: such a file is decoded and split by one task.
    """
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, head_bytes).alias("h"), F.is_valid_utf8(F.col("content")).alias("utf8")).first()
    sep, enc = sniff(bytes(first["h"]) if first else b"")
    if first and enc == "UTF-8" and not first["utf8"]:
        enc = "windows-1252"
    if enc == "windows-1252":

        def split(content: bytes) -> Iterator[tuple]:
            for i, row in enumerate(csv.reader(io.StringIO(_single_byte(content), newline=""), delimiter=sep)):
                yield i, row

        cells = parsed(files(spark, path), split, "i int, r array<string>")
        names = cells.where("i = 0").first()["r"]
        return cells.where("i > 0").select(*(F.nullif(F.get("r", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)))
    return spark.read.csv(path, header=True, sep=sep, encoding=enc, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False)


def points_from_columns(df: DataFrame) -> DataFrame:
    """Adds ``geom`` (x, y, z) from columns named as coordinates usually are; unchanged if there are none."""
    names = {c.strip().lower(): c for c in df.columns}
    find = lambda *opts: next((names[o] for o in opts if o in names), None)
    x, y, z = find("x", "e", "est", "east", "easting"), find("y", "n", "nord", "north", "northing"), find("z", "quota", "q", "h", "elev")
    if not x or not y:
        return df
    num = lambda c: F.replace(F.trim(F.col(f"`{c}`")), F.lit(","), F.lit(".")).try_cast("double") if c else F.lit(None).cast("double")
    return df.withColumn("geom", F.when(num(x).isNotNull() & num(y).isNotNull(), F.struct(num(x).alias("x"), num(y).alias("y"), num(z).alias("z"))))


def wkt_parts(c: Column) -> Column:
    """Parts of a WKT geometry: an array of arrays of (x, y, z)."""
    rings = F.regexp_extract_all(c, F.lit(r"\(([^()]+)\)"), 1)

    def pts(ring: Column) -> Column:
        return F.transform(F.split(F.trim(ring), r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"), F.get(F.split(F.trim(p), r"\s+"), F.lit(2)).cast("double").alias("z")))

    return F.transform(rings, pts)


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        names = [r[0] for r in c.execute("select name from sqlite_master where type = 'table' order by name")]
    return [n for n in names if not n.lower().startswith(tuple(s.lower() for s in SYSTEM_TABLES))]


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[_Rows]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            lo, hi = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if lo is None:
            return [_Rows(0, -1)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [_Rows(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, p: _Rows) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            cols = ", ".join(f'"{n}"' for n in self.columns)
            for row in c.execute(f'select {cols} from "{self.table}" where rowid between ? and ?', (p.lo, p.hi)):
                yield tuple(v.decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else str(v) for v in row)


class SqliteTable(DataSource):
    """``spark.read.format("sqlite-table").option("table", ...).load(path)``: one table as text, in rowid ranges.

    Columns of bytes that are not mostly UTF-8 text are left out. The file must be at the same path on all workers.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite-table"

    def _columns(self) -> list[str]:
        path, table = self.options["path"], self.options["table"]
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            c.create_function("is_text", 1, _is_text)
            names = [r[1] for r in c.execute(f'pragma table_info("{table}")')]
            share = {n: c.execute(f'select avg(is_text("{n}")) from "{table}" where typeof("{n}") = \'blob\'').fetchone()[0] for n in names}
        return [n for n in names if share[n] is None or share[n] >= 0.9]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("partitions", 8)))


def _is_text(b: bytes) -> bool:
    try:
        return "\0" not in b.decode("utf-8")
    except UnicodeDecodeError:
        return False


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)
