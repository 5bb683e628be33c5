"""Log stores by name: each is a namespace of the session's catalog with external tables over a folder's files.

Rows and bytes are statistics that the catalog keeps: they are counted from the files' footers when a store is added or refreshed,
and a listing reads no file.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..tables import shared_dir

#: Formats whose files tell their own columns, by the ending of a table's file or folder.
SELF_DESCRIBING = {".parquet": "parquet", ".orc": "orc"}
TABLES = "table_name string, format string, location string, n_columns int, n_rows long, n_bytes long"
FOUND = "table_name string, column_name string, value string"
STORES = "store string, location string, is_default boolean, deletable boolean, n_tables int"


class Entry(NamedTuple):
    store: str
    location: str
    is_default: bool
    deletable: bool
    n_tables: int


def safe_name(name: str) -> str:
    """Letters, digits and _ of name's last part without its ending, in lower case; ``store`` where nothing is left."""
    last = name.rstrip("/").rsplit("/", 1)[-1].lstrip(".").rsplit(".", 1)[0]
    return re.sub(r"[^a-z0-9_]", "", last.lower()) or "store"


class Catalogue:
    """The stores of a session. The default one can't be removed, and every call without a name means it.

    What a store's folder holds at ``add`` is what the store has, one table a file or folder with a known ending; other files are passed over. A folder with
    a table that can't be read is refused whole. Names in use get _2, _3 and so on. The files are never changed, by ``remove`` neither.
    """

    def __init__(self, spark: SparkSession, default_path: str, prefix: str = "logs_"):
        self.spark, self.prefix = spark, prefix
        self.default = self._create(default_path, "default")

    def add(self, path: str, name: str | None = None) -> str:
        return self._create(path, safe_name(name or path))

    def stores(self) -> DataFrame:
        """All stores, the default one first."""
        return self.spark.createDataFrame([tuple(self._entry(n)) for n in self._stores()], STORES)

    def resolve(self, store: str | None = None) -> Entry:
        """ValueError for a name that no store has, FileNotFoundError where its folder is gone."""
        wanted = (store or "").strip() or self.default
        if wanted not in self._stores():
            raise ValueError(f"no store {wanted}")
        entry = self._entry(wanted)
        if not self._exists(entry.location):
            raise FileNotFoundError(f"the folder of {wanted} is gone: {entry.location}")
        return entry

    def tables(self, store: str | None = None) -> DataFrame:
        """A row a table, from what the catalog keeps; n_rows and n_bytes are those of the last ``add`` or ``refresh``."""
        entry, rows = self.resolve(store), []
        for name in self._names(entry.store):
            told = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._quoted(entry.store, name)}").collect()}
            size = re.fullmatch(r"(\d+) bytes, (\d+) rows", told["Statistics"])
            rows.append((name, told["Provider"].lower(), told["Location"], len(self.table(name, entry.store).columns), int(size[2]), int(size[1])))
        return self.spark.createDataFrame(rows, TABLES)

    def table(self, name: str, store: str | None = None) -> DataFrame:
        entry = self.resolve(store)
        if name not in self._names(entry.store):
            raise ValueError(f"no table {name} in {entry.store}")
        return self.spark.table(self._quoted(entry.store, name))

    def search(self, term: str, store: str | None = None) -> DataFrame:
        """(table_name, column_name, value) of each text of a store's tables that holds term, without case; one row a cell, texts whole.

        Each table is read once, its string columns only, and nothing is shuffled. term is plain text; an empty one is a ValueError. Nulls hold nothing.
        """
        if not term:
            raise ValueError("an empty term is in every text")
        entry, wanted = self.resolve(store), term.lower()
        found = [self.spark.createDataFrame([], FOUND)]
        for name in self._names(entry.store):
            df = self.spark.table(self._quoted(entry.store, name))
            texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
            if texts:
                cells = F.array(*(F.struct(F.lit(c).alias("column_name"), df[f"`{c}`"].alias("value")) for c in texts))
                found.append(df.select(F.lit(name).alias("table_name"), F.inline(F.filter(cells, lambda x: F.contains(F.lower(x["value"]), F.lit(wanted))))))
        return reduce(DataFrame.unionByName, found)

    def refresh(self, store: str | None = None) -> None:
        """Takes in files that were added to the tables, and counts again."""
        entry = self.resolve(store)
        for name in self._names(entry.store):
            self._count(self._quoted(entry.store, name))

    def remove(self, store: str) -> None:
        if self.resolve(store).is_default:
            raise ValueError("the default store can't be removed")
        self._drop(store)

    def close(self) -> None:
        """Removes all stores of this catalogue, the default one too."""
        for store in self._stores():
            self._drop(store)

    def _quoted(self, *parts: str) -> str:
        first, *rest = parts
        return ".".join(f"`{p}`" for p in (self.prefix + first, *rest))

    def _drop(self, store: str) -> None:
        self.spark.sql(f"DROP NAMESPACE IF EXISTS {self._quoted(store)} CASCADE")

    def _stores(self) -> list[str]:
        """Names of all stores, the default one first."""
        shown = (r[0] for r in self.spark.sql("SHOW NAMESPACES").collect())
        return sorted((n[len(self.prefix) :] for n in shown if n.startswith(self.prefix)), key=lambda n: (n != "default", n))

    def _entry(self, store: str) -> Entry:
        told = {r[0]: r[1] for r in self.spark.sql(f"DESCRIBE NAMESPACE {self._quoted(store)}").collect()}
        return Entry(store, told["Comment"], store == "default", store != "default", len(self._names(store)))

    def _names(self, store: str) -> list[str]:
        return sorted(r.tableName for r in self.spark.sql(f"SHOW TABLES IN {self._quoted(store)}").collect() if not r.isTemporary)

    def _path(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, files = self._path(path)
        return files.exists(at)

    def _children(self, path: str) -> dict[str, tuple[str, str]]:
        """Table name → (format, location). Names that become the same get numbers, in the order of the files' names."""
        at, files = self._path(path)
        if not files.exists(at) or not files.getFileStatus(at).isDirectory():
            raise FileNotFoundError(f"no folder {path}")
        found: dict[str, tuple[str, str]] = {}
        for child in sorted(s.getPath().toString() for s in files.listStatus(at)):
            ending = next((e for e in SELF_DESCRIBING if child.endswith(e)), None)
            if ending and not child.rsplit("/", 1)[-1].startswith(("_", ".")):
                found[_free(safe_name(child), found)] = SELF_DESCRIBING[ending], child
        return found

    def _count(self, table: str) -> None:
        self.spark.catalog.refreshTable(table)
        self.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")

    def _create(self, path: str, wanted: str) -> str:
        children = self._children(path)
        store = _free(wanted, self._stores()) if wanted != "default" else wanted
        if store == "default":  # that of an earlier object
            self._drop(store)
        # A namespace's own folder goes with it when it is dropped, so it is never the folder with the files.
        own = f"{shared_dir(self.spark)}/catalogue-{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE NAMESPACE {self._quoted(store)} COMMENT {_literal(path)} LOCATION {_literal(own)}")
        try:
            for name, (fmt, location) in children.items():
                table = self._quoted(store, name)
                self.spark.sql(f"CREATE TABLE {table} USING {fmt} LOCATION {_literal(location)}")
                if not self.spark.table(table).columns:
                    raise ValueError(f"{location} has no columns")
                self._count(table)
        except (PySparkException, Py4JJavaError, ValueError) as broken:
            self._drop(store)
            raise ValueError(f"{path} isn't a readable store: {broken}") from broken
        return store


def _free(name: str, taken) -> str:
    n, free = 2, name
    while free in taken:
        free, n = f"{name}_{n}", n + 1
    return free


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
