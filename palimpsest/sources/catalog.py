"""Table schemas: one JSON file for each table under a root folder."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .files import Files

#: Type names of the SQL surface. None of them narrows: whole numbers have 64 bits, others are doubles.
TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(("INT", "INT8", "INT4", "INTEGER", "BIGINT"), T.LongType()),
    **dict.fromkeys(("TEXT", "STRING", "VARCHAR", "CHAR"), T.StringType()),
    **dict.fromkeys(("BOOL", "BOOLEAN"), T.BooleanType()),
    **dict.fromkeys(("FLOAT", "FLOAT8", "FLOAT4", "REAL", "DOUBLE PRECISION"), T.DoubleType()),
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class CatalogError(ValueError):
    pass


def column_type(name: str) -> T.DataType:
    """The type of a SQL name; a length, as in VARCHAR(20), is not enforced."""
    plain = re.sub(r"\s*\(\s*\d+\s*\)$", "", " ".join(name.upper().split()))
    if plain not in TYPES:
        raise CatalogError(f"{name!r} is not a type that columns can have")
    return TYPES[plain]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    key: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, n != self.key, {"primary_key": True} if n == self.key else {}) for n, t in self.columns])

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    @property
    def log_schema(self) -> T.StructType:
        """The version log: the table's columns (nullable, for deletions) and each version's own."""
        own = [T.StructField("wall", T.LongType()), T.StructField("logical", T.IntegerType()), T.StructField("tombstone", T.BooleanType())]
        return T.StructType([T.StructField(n, t) for n, t in self.columns] + own)


def table_of(name: str, columns: list[tuple[str, T.DataType]], keys: list[str]) -> Table:
    """A checked table: one key, of whole numbers or text; distinct column names that do not clash with a version's own."""
    lower = [n.lower() for n, _ in columns]
    if not _NAME.fullmatch(name) or not columns or not all(_NAME.fullmatch(n) for n, _ in columns):
        raise CatalogError(f"not a valid table or column name in {name!r}")
    if len(set(lower)) < len(lower) or {"wall", "logical", "tombstone"} & set(lower):
        raise CatalogError("column names must differ from each other and from wall, logical and tombstone")
    if len(keys) != 1:
        raise CatalogError(f"table {name!r} needs exactly one PRIMARY KEY column")
    found = {n.lower(): (n, t) for n, t in columns}
    if keys[0].lower() not in found:
        raise CatalogError(f"no column {keys[0]!r} for the primary key")
    key, kind = found[keys[0].lower()]
    if not isinstance(kind, T.LongType | T.StringType):
        raise CatalogError(f"primary key {key!r} must be INT or TEXT")
    return Table(name, tuple(columns), key)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _path(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise CatalogError(f"not a valid table name: {name!r}")
        return f"{self.root}/_catalog/{name.lower()}.json"

    def create(self, table: Table) -> None:
        spec = {"name": table.name, "key": table.key, "columns": [[n, t.simpleString()] for n, t in table.columns]}
        try:
            self.files.create(self._path(table.name), json.dumps(spec))
        except FileExistsError:
            raise CatalogError(f"there is a table named {table.name!r} already") from None

    def get(self, name: str) -> Table:
        path = self._path(name)
        if not self.files.exists(path):
            raise CatalogError(f"no table is named {name!r}")
        spec = json.loads(self.files.read(path))
        kinds = {t.simpleString(): t for t in TYPES.values()}
        return Table(spec["name"], tuple((n, kinds[t]) for n, t in spec["columns"]), spec["key"])

    def drop(self, name: str) -> None:
        """Removes the schema; rows stay until the table's folder is deleted (see VersionStore.clear)."""
        self.get(name)
        self.files.delete(self._path(name))

    def named(self, words: set[str]) -> list[str]:
        """Those of some lower-case words that are names of tables: one listing, and no schema is read."""
        return sorted(words & {n.removesuffix(".json") for n in self.files.names(f"{self.root}/_catalog")})

    def list(self) -> list[str]:
        names = [n.removesuffix(".json") for n in self.files.names(f"{self.root}/_catalog") if n.endswith(".json")]
        return sorted(self.get(n).name for n in names)

    def as_table(self) -> DataFrame:
        """name, key, columns of every table, by name."""
        rows = [(t.name, t.key, len(t.columns)) for t in map(self.get, self.list())]
        return self.spark.createDataFrame(rows, "name string, key string, columns int").orderBy("name")
