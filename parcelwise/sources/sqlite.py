"""Tables of SQLite files as a Spark source: ``spark.read.format("sqlite")`` with options path, table and partitions.

Rows are read by ranges of their row numbers, a range a task, and conditions that SQLite can answer are left to it. The
file must lie where all executors can open it.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Conditions that mean the same to SQLite.
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
KINDS = ((("INT",), LongType()), (("BOOL",), BooleanType()), (("REAL", "FLOA", "DOUB", "NUM", "DEC"), DoubleType()), (("BLOB",), BinaryType()))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


class Range(InputPartition):
    """Row numbers from ``low`` up to but not with ``high``."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = max(1, int(options.get("partitions", "8")))
        self.conditions: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Keep what SQLite answers as Spark does, comparisons of numbers and texts by value; give back the rest."""
        for f in filters:
            if type(f) in OPERATORS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.conditions.append((f"{quoted(f.attribute[0])} {OPERATORS[type(f)]} ?", (f.value,)))
            elif isinstance(f, In) and len(f.attribute) == 1 and all(isinstance(v, (int, float, str)) for v in f.value):
                self.conditions.append((f"{quoted(f.attribute[0])} IN ({', '.join('?' * len(f.value))})", tuple(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)) and len(f.attribute) == 1:
                self.conditions.append((f"{quoted(f.attribute[0])} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", ()))
            else:
                yield f

    def partitions(self) -> list[Range]:
        with opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(map(quoted, self.schema.names)) or "NULL"
        where = " AND ".join(["rowid >= ? AND rowid < ?", *(c for c, _ in self.conditions)])
        values = [partition.low, partition.high, *(v for _, vs in self.conditions for v in vs)]
        kinds = [f.dataType for f in self.schema]
        with opened(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {where}", values):
                yield tuple(None if v is None else bool(v) if isinstance(k, BooleanType) else float(v) if isinstance(k, DoubleType) else v for v, k in zip(row, kinds, strict=True))


class SqliteSource(DataSource):
    """A table of one SQLite file; its schema follows from the declared types of the columns, text where none is known."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        kind = lambda declared: next((k for parts, k in KINDS if any(p in declared.upper() for p in parts)), StringType())
        return StructType([StructField(name, kind(declared or "")) for _, name, declared, *_ in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file; conditions on it are pushed where the session allows Python sources that."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()
