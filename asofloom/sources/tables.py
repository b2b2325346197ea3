"""Tables by name: given DataFrames, catalog names, or paths."""

from pyspark.sql import DataFrame


class Tables:
    """Resolves the table names of a configuration.

    ``given`` maps names to DataFrames or paths; ``folder`` holds ``<name>.parquet`` files. What neither has comes from the catalog.
    """

    def __init__(self, spark, given=None, folder=None):
        self.spark, self.given, self.folder = spark, dict(given or {}), folder

    def __call__(self, name) -> DataFrame:
        found = self.given.get(name)
        if isinstance(found, DataFrame):
            return found
        if found is not None:
            return read(self.spark, found)
        if self.folder and not self.spark.catalog.tableExists(name):
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.spark.table(name)


def read(spark, path, **options):
    """A table from a path, by its ending: csv (with a header), json, orc, else Parquet."""
    kind = str(path).rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.options(**options).json(path)
    return getattr(spark.read.options(**options), "orc" if kind == "orc" else "parquet")(path)
