"""A read-only data source over SQLite, for the external index: options `path` and `table` (its columns are read as
text, whole numbers or floating ones, as the table declares), `tasks` (8), the ranges of row ids that are read at once, and
`pushdown`.

With pushdown, filters go into SQLite's WHERE where both engines agree on them (see condition), and Spark applies the others.
Spark takes that from a Python source only with spark.sql.python.filterPushdown.enabled, and refuses such a source without.
Views and tables without row ids are read by one task.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

TASKS = 8
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def condition(asked: Filter, kinds: dict[str, T.DataType]) -> tuple[str, list] | None:
    """SQL and its parameters for a filter, or None. Numbers compare by value and texts by bytes in both engines; a column may
    hold values of other types than it declares, which are cast as they are read, so the cast is what is compared."""
    column = asked.attribute[0] if len(asked.attribute) == 1 else None
    if column not in kinds:
        return None
    kind = "INTEGER" if isinstance(kinds[column], T.LongType) else "REAL" if isinstance(kinds[column], T.DoubleType) else "TEXT"
    name = f"CAST({quoted(column)} AS {kind})"
    fits = lambda x: isinstance(x, str) if kind == "TEXT" else isinstance(x, (int, float)) and not isinstance(x, bool)
    if isinstance(asked, IsNotNull):
        return f"{quoted(column)} IS NOT NULL", []
    if isinstance(asked, IsNull):
        return f"{quoted(column)} IS NULL", []
    if isinstance(asked, In) and asked.value and all(map(fits, asked.value)):
        return f"{name} IN ({', '.join('?' * len(asked.value))})", list(asked.value)
    if type(asked) in COMPARED and fits(asked.value):
        return f"{name} {COMPARED[type(asked)]} ?", [asked.value]
    return None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with connect(self.options["path"]) as db:
            columns = db.execute(f"select name, upper(type) from pragma_table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r}")
        kind = lambda t: T.LongType() if "INT" in t else T.DoubleType() if any(x in t for x in ("REAL", "FLOA", "DOUB")) else T.StringType()
        return T.StructType([T.StructField(n, kind(t)) for n, t in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _Pushing if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options["path"], self.options["table"], schema, int(self.options.get("tasks", TASKS)))


@dataclass
class Rows(InputPartition):
    where: str
    values: list


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, tasks: int):
        self.path, self.table, self.tasks, self.fields = path, table, tasks, [(f.name, f.dataType) for f in schema]
        self.where: list[tuple[str, list]] = []

    def partitions(self) -> list[Rows]:
        """Ranges of row ids, each with the pushed filters."""
        where, values = [w for w, _ in self.where], [v for _, x in self.where for v in x]
        try:
            with connect(self.path) as db:
                low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # no row ids
            return [Rows(" and ".join(where) or "1", values)]
        if low is None:
            return [Rows("0", [])]
        step = -(-(high - low + 1) // self.tasks)
        return [Rows(" and ".join([*where, f"rowid between {a} and {min(a + step - 1, high)}"]), values) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        casts = [(lambda x: x if x is None else int(x)) if isinstance(t, T.LongType) else (lambda x: x if x is None else float(x)) if isinstance(t, T.DoubleType) else (lambda x: x if x is None else str(x)) for _, t in self.fields]
        with connect(self.path) as db:
            for row in db.execute(f"select {', '.join(quoted(n) for n, _ in self.fields)} from {quoted(self.table)} where {partition.where}", partition.values):
                yield tuple(c(x) for c, x in zip(casts, row, strict=True))


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = dict(self.fields)
        for asked in filters:
            found = condition(asked, kinds)
            if found:
                self.where.append(found)
            else:
                yield asked
