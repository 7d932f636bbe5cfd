"""Versions of a lake: which directories hold its tables, swapped in one step.

    <root>/_versions/<number>.json      the live directories of every table
    <root>/<table>/load=<id>/...        what one load has written, by date range
    <root>/_staging/<id>/...            what a load computes before it writes

Directories are never changed once they are written. A load writes new ones and
then the next version file, which lists them in place of those they replace. A
reader takes the newest version file, so it sees all tables as they were before
a load or as they are after it; a load that dies leaves files that no version
names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from daytally.schemas import LAKE_TABLES


class ConcurrentLoadError(RuntimeError):
    """Another load has finished since this one started; nothing of this one is live."""


@dataclass(frozen=True)
class Stored:
    """A table: its columns, those of its directories, and the live directories,
    as paths below the root."""

    columns: tuple[str, ...]
    parts: tuple[str, ...] = ()
    directories: tuple[str, ...] = ()


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, Stored] = field(default_factory=dict)
    #: names of the deliveries whose lines are in the tables
    deliveries: tuple[str, ...] = ()


def values(directory: str) -> dict[str, int]:
    """The date range a directory holds, from its path."""
    return {k: int(v) for k, v in re.findall(r"(year|month)=(\d+)", directory)}


class Files:
    """The file system of a lake, whichever Spark reaches it by."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.fs = self.hadoop.Path(self.root).getFileSystem(self.conf)

    def place(self, path: str):
        return self.hadoop.Path(f"{self.root}/{path}")

    def listed(self, path: str) -> list[tuple[str, bool, int]]:
        """name, is a directory, time of change in ms"""
        if not self.fs.exists(self.place(path)):
            return []
        return [(s.getPath().getName(), s.isDirectory(), s.getModificationTime()) for s in self.fs.listStatus(self.place(path))]

    def leaves(self, path: str, depth: int) -> list[str]:
        """Directories `depth` levels below path."""
        if depth == 0:
            return [path]
        return [x for name, folder, _ in self.listed(path) if folder and "=" in name for x in self.leaves(f"{path}/{name}", depth - 1)]

    def text(self, path: str) -> str:
        stream = self.fs.open(self.place(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> bool:
        """Make a whole file at once; False when there is one of that name. The
        rename does not overwrite, and is one step wherever the file system's is."""
        whole = self.place(f"{path}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(whole, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self.hadoop, "Options$Rename")
        context = self.hadoop.FileContext.getFileContext(whole.toUri(), self.conf)
        try:
            context.rename(whole, self.place(path), self.gateway.new_array(rename, 0))
        except Py4JJavaError as error:
            self.fs.delete(whole, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.place(path), True)


def numbers(files: Files) -> list[int]:
    found = (re.fullmatch(r"(\d+)\.json", name) for name, _, _ in files.listed("_versions"))
    return sorted(int(m[1]) for m in found if m)


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The newest version, or an older one; number 0, without tables, before any load."""
    files = Files(spark, root)
    if number is None:
        number = max(numbers(files), default=0)
    if number == 0:
        return Version()
    made = json.loads(files.text(f"_versions/{number}.json"))
    tables = {name: Stored(*(tuple(x[k]) for k in ("columns", "parts", "directories"))) for name, x in made["tables"].items()}
    return Version(number, tables, tuple(made["deliveries"]))


def read(spark: SparkSession, root: str, name: str, table: Stored, directories: Iterable[str] | None = None) -> DataFrame:
    """A table, or some of its directories, under its fixed column types. A column that
    a file does not have is NULL; nothing is inferred from the files."""
    types = LAKE_TABLES[name]
    columns = [types[c] for c in table.columns]
    parts = [StructField(c, IntegerType()) for c in table.parts]
    paths = [f"{root.rstrip('/')}/{d}" for d in (table.directories if directories is None else directories)]
    if not paths:
        return spark.createDataFrame([], StructType([*columns, *parts]))
    schema = StructType([*columns, StructField("load", StringType()), *parts])
    return spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/{name}").parquet(*paths).drop("load")


def typed(df: DataFrame, name: str) -> DataFrame:
    """Rows with the table's own column types, in its column order. A column that the
    table does not know is an error, and so is a value that its type does not hold."""
    types = LAKE_TABLES[name]
    unknown = set(df.columns) - set(types.names)
    if unknown:
        raise ValueError(f"{name}: unknown columns {sorted(unknown)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types if f.name in df.columns])


class Change:
    """One load: writes directories beside the live ones, and makes them live together.

        with Change(spark, root) as change:
            change.write(...)

    The end of the block writes the next version; when another load has done so
    since the block began, ConcurrentLoadError is raised. After an error inside the block
    nothing has changed for readers, and what was written is deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base = version(spark, root)
        self.tables, self.deliveries = dict(self.base.tables), self.base.deliveries
        self.id = f"l{uuid.uuid4().hex}"
        self.files = Files(spark, root)
        self.written: list[str] = []

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, error, trace) -> None:
        live = False
        try:
            if error is None:
                self._commit()
                live = True
        finally:
            self.files.delete(f"_staging/{self.id}")
            for path in [] if live else self.written:
                self.files.delete(path)

    def _commit(self) -> None:
        if (self.tables, self.deliveries) == (self.base.tables, self.base.deliveries):
            return
        number = self.base.number + 1
        tables = {n: {"columns": t.columns, "parts": t.parts, "directories": t.directories} for n, t in self.tables.items()}
        text = json.dumps({"tables": tables, "deliveries": self.deliveries}, indent=1)
        if not self.files.put(f"_versions/{number}.json", text):
            raise ConcurrentLoadError(f"{self.root}: version {number} was made by another load")

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """df computed once, for what this load does with it."""
        path = f"{self.root}/_staging/{self.id}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stored(self, name: str) -> Stored:
        return self.tables.get(name, Stored(()))

    def touched(self, name: str, new: Iterable[str]) -> list[str]:
        """The table's other directories that share a date range with one of the new ones."""
        new = set(new)
        ranges = [v for v in map(values, new) if v]
        return [d for d in self.stored(name).directories if d not in new and values(d) in ranges]

    def several(self, name: str) -> list[str]:
        """The live directories that share their date range with another one."""
        held = [tuple(values(d).items()) for d in self.stored(name).directories]
        return [d for d, v in zip(self.stored(name).directories, held, strict=True) if held.count(v) > 1]

    def read(self, name: str, directories: Iterable[str] | None = None) -> DataFrame:
        return read(self.spark, self.root, name, self.stored(name), directories)

    def write(
        self, name: str, df: DataFrame, order: list[str], parts: tuple[str, ...] = (), replaces: Iterable[str] = (),
        anew: bool = False, laid_out: bool = False,
    ) -> tuple[str, ...]:
        """Write rows (typed, with the columns of `parts`) and list their directories in
        place of those they replace; `anew`: in place of all, columns included. Returns
        the new directories.

        Rows are rebalanced by directory: AQE splits a month that holds most rows
        over several tasks and merges small ones, so neither one hot task nor many
        tiny files come out. `laid_out`: each task has rows of few directories already, so
        they are written as they come. Inside a file rows are sorted, which keeps its
        row-group statistics narrow.
        """
        path = f"{name}/load={self.id}"
        if path in self.written:  # one more write of this load
            path += f"-{len(self.written)}"
        self.written.append(path)
        rows = df if laid_out else df.hint("rebalance", *parts)
        rows.sortWithinPartitions(*parts, *order).write.partitionBy(*parts).option("compression", "zstd").parquet(f"{self.root}/{path}")
        new = tuple(self.files.leaves(path, len(parts)))
        if not new:
            self.files.delete(path)
        old = Stored(()) if anew else self.stored(name)
        known = {*old.columns, *df.columns}
        kept = tuple(d for d in old.directories if d not in set(replaces))
        self.tables[name] = Stored(tuple(c for c in LAKE_TABLES[name].names if c in known), tuple(parts), kept + new)
        return new

    def retire(self, name: str, directories: Iterable[str]) -> None:
        """Take directories off a table."""
        held, gone = self.stored(name), set(directories)
        self.tables[name] = Stored(held.columns, held.parts, tuple(d for d in held.directories if d not in gone))

    def applied(self, delivery: str) -> None:
        self.deliveries = (*self.deliveries, delivery)


def vacuum(spark: SparkSession, root: str, keep: int = 1, hours: float = 24) -> list[str]:
    """Delete what none of the newest `keep` versions names, if it is older than `hours`,
    so that a load that is still running loses nothing. Returns the paths."""
    files = Files(spark, root)
    numbered = numbers(files)
    live = {t for n in numbered[-keep:] for stored in version(spark, root, n).tables.values() for t in stored.directories}
    loads = {"/".join(d.split("/")[:2]) for d in live}
    before = spark._jvm.java.lang.System.currentTimeMillis() - hours * 3_600_000
    gone = [f"_versions/{n}.json" for n in numbered[:-keep]]
    for table in LAKE_TABLES:
        for name, folder, changed in files.listed(table):
            if folder and f"{table}/{name}" not in loads and changed < before:
                gone.append(f"{table}/{name}")
    gone += [f"_staging/{name}" for name, _, changed in files.listed("_staging") if changed < before]
    for path in gone:
        files.delete(path)
    return gone

