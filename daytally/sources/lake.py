"""Stored dimensions and date-partitioned facts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytally.functions.windows import Window, clip, inclusive, trailing_days
from daytally.sources import versions


class Lake:
    """The tables as written by `daytally.operators.loading`.

    Every table is read under its fixed types and with all columns it was ever
    delivered with. The columns of the directories serve the window that is asked
    for here and are then dropped. Each table is taken from the newest version, or from
    the one that is named; a DataFrame keeps the version it was made from.
    """

    keys_are_grouped = False

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self._version = version

    def version(self) -> versions.Version:
        return versions.version(self.spark, self.root, self._version)

    def pinned(self) -> Lake:
        """The lake as it is now, whatever is loaded later."""
        return Lake(self.spark, self.root, self.version().number)

    def stored(self, name: str) -> versions.Stored:
        tables = self.version().tables
        if name not in tables:
            raise ValueError(f"nothing is stored for {name} below {self.root}")
        return tables[name]

    def table(self, name: str) -> DataFrame:
        return versions.read(self.spark, self.root, name, self.stored(name))

    @property
    def stores(self) -> DataFrame:
        return self.table("stores")

    located_stores = stores

    @property
    def items(self) -> DataFrame:
        return self.table("items")

    def store_days(self, window: Window | None = None, measures: tuple[str, ...] | None = None) -> DataFrame:
        return self._facts("da_stores_date", ["store_id", "date"], window, measures)

    def item_days(self, window: Window | None = None, measures: tuple[str, ...] | None = None) -> DataFrame:
        return self._facts("da_items_stores_date", ["item_id", "store_id", "date"], window, measures)

    def _facts(self, name: str, keys: list[str], window: Window | None, measures: tuple[str, ...] | None) -> DataFrame:
        stored = self.stored(name)
        if measures is None:
            measures = tuple(c for c in stored.columns if c not in keys)
        return clip(versions.read(self.spark, self.root, name, stored), window).select(*keys, *measures)

    def _newest_directories(self, name: str) -> Iterator[DataFrame]:
        """The table's newest date range, then the two newest ones, and so on."""
        stored = self.stored(name)
        ranges = sorted({tuple(versions.values(d).items()) for d in stored.directories}, reverse=True)
        for n in range(1, len(ranges) + 1):
            newest = [d for d in stored.directories if tuple(versions.values(d).items()) in ranges[:n]]
            yield versions.read(self.spark, self.root, name, stored, newest)

    def newest_date(self, name: str = "da_items_stores_date") -> date | None:
        """Newest fact date, for use as as_of. The newest directory is known by its
        name, so that only its date column is read."""
        for df in self._newest_directories(name):
            return df.agg(F.max("date")).first()[0]
        return None

    def newest_window(self, days: int) -> Window:
        """The last `days` days up to the newest item fact. The date is fetched first,
        from the newest directory, so that the window skips directories."""
        return trailing_days(self.newest_date() or date.min.replace(year=1000), days)

    def newest_dates(self, k: int) -> Window:
        """The window of the k newest dates with store facts. Directories are opened
        from the newest on until they hold k dates; two dates are fetched."""
        window = date.max, date.max
        for df in self._newest_directories("da_stores_date"):
            dates = df.select("date").distinct().orderBy(F.desc("date")).limit(k)
            n, first, last = dates.agg(F.count("*"), F.min("date"), F.max("date")).first()
            if n:
                window = inclusive(first, last)
            if n == k:
                break
        return window

    def store_ids(self) -> DataFrame:
        """Stores with any fact, from the key column alone."""
        return self.table("da_stores_date").select("store_id").distinct()
