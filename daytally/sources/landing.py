"""Landing files: the four tables as they are delivered."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daytally.functions.windows import Window, clip
from daytally.schemas import TABLES

log = logging.getLogger(__name__)


def read_typed(spark: SparkSession, table: str, path: str, file_format: str = "parquet") -> DataFrame:
    """Scan files under the table's fixed schema; nothing is inferred.

    Columns are bound by name, in CSV by the header line of the files, so their
    order does not matter; ones that a file leaves out are NULL. A header with a
    column the table does not know, and a field that does not parse, are errors.
    """
    schema = TABLES[table]
    if file_format != "csv":
        return spark.read.schema(schema).format(file_format).load(path)
    # the header alone; files of one folder must have the same one
    header = spark.read.option("header", True).csv(path).columns
    unknown = set(header) - set(schema.names)
    if unknown:
        raise ValueError(f"{table}: unknown columns {sorted(unknown)} in {path}")
    reader = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    found = reader.schema(StructType([schema[c] for c in header])).csv(path)
    return found.select(*[f.name if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def read_if_there(spark: SparkSession, table: str, path: str, file_format: str = "parquet") -> DataFrame | None:
    """As `read_typed`; a missing path is a warning and gives None."""
    try:
        return read_typed(spark, table, path, file_format)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log.warning("nothing to load for %s at %s", table, path)
        return None


class Landing:
    """A source over a folder with one file or folder per table, or per part of a
    fact table (`<table>*`), as Parquet or CSV.

    A dimension that is missing is an error, since loading replaces it. A fact
    table without any file is a warning: `load` leaves what is stored.
    """

    keys_are_grouped = False  # delivered keys must be checked

    def __init__(self, spark: SparkSession, folder: str, file_format: str = "parquet"):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.file_format = file_format

    @property
    def stores(self) -> DataFrame:
        return read_typed(self.spark, "stores", f"{self.folder}/stores*", self.file_format)

    located_stores = stores

    @property
    def items(self) -> DataFrame:
        return read_typed(self.spark, "items", f"{self.folder}/items*", self.file_format)

    def _facts(self, table: str, window: Window | None, keys: list[str], measures: tuple[str, ...] | None) -> DataFrame | None:
        df = read_if_there(self.spark, table, f"{self.folder}/{table}*", self.file_format)
        if df is None:
            return None
        df = clip(df, window)
        return df if measures is None else df.select(*keys, *measures)

    def store_days(self, window: Window | None = None, measures: tuple[str, ...] | None = None) -> DataFrame | None:
        return self._facts("da_stores_date", window, ["store_id", "date"], measures)

    def item_days(self, window: Window | None = None, measures: tuple[str, ...] | None = None) -> DataFrame | None:
        return self._facts("da_items_stores_date", window, ["item_id", "store_id", "date"], measures)
