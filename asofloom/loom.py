"""The public entry point: a configuration, its feature plan, and the matrix in several forms."""


import re
from collections import OrderedDict

from pyspark.sql import types as T

from .boundary import AS_OF, q
from .output import imputation, manifest
from .plans.compile import Compiler, as_of_frame
from .plans.planner import Planner
from .sources.config import load
from .sources.tables import Tables

#: Columns of one group of a wide matrix. Very wide plans are slow to compile and exceed the size of generated methods.
GROUP_COLUMNS = 500


class Loom:
    """Point-in-time features of a target entity.

    config: a path, YAML text or mapping. spark: a session. as_of: the as-of dates, as a list or a DataFrame with as_of_date; by default the
    table as_of_dates. tables: DataFrames or paths by table name; folder: where else <name>.parquet is looked for.
    """

    def __init__(self, config, spark=None, as_of=None, tables=None, folder=None, *, validate=True, group_columns=GROUP_COLUMNS):
        self.config = load(config, validate)
        self.spark, self.group_columns = spark, group_columns
        self._as_of, self._given, self._folder = as_of, tables, folder
        self._vocabularies()
        self.planner = Planner(self.config)

    @property
    def tables(self):
        if self.spark is None:
            raise ValueError("a Spark session is needed to read tables")
        return Tables(self.spark, self._given, self._folder)

    @property
    def target(self):
        return self.planner.graph.entities[self.planner.target]

    @property
    def keys(self):
        return [AS_OF, *([self.target.id] if self.target.id else [])]

    def _vocabularies(self):
        """Fills in a categorical role's missing vocabulary from the field's metadata, under the key enum. It is never learned from rows."""
        for e in self.config["entities"]:
            for name, v in (e.get("variables") or {}).items():
                if e["alias"] == self.config["target"] and isinstance(v, dict) and v.get("role") == "categorical" and not v.get("vocabulary") and self.spark is not None:
                    found = self.tables(e["table"]).schema[name].metadata.get("enum")
                    if found:
                        v["vocabulary"] = list(found)

    # ---- what there will be

    @property
    def features(self):
        return [f.name for f in self.planner.output]

    @property
    def manifest(self):
        return manifest.build(self.planner.output)

    def manifest_dataframe(self):
        return manifest.to_pandas(self.manifest)

    def manifest_matching(self, patterns):
        return manifest.matching(self.manifest, patterns)

    def columns_matching(self, patterns):
        return [e.column for e in self.manifest_matching(patterns)]

    @property
    def groups(self):
        """The feature names in groups of at most group_columns."""
        n = self.features
        return [n[i : i + self.group_columns] for i in range(0, len(n), self.group_columns)] or [[]]

    # ---- the matrix

    def to_spark(self, columns=None, impute=False, **options):
        """The matrix, or some of its columns, as a lazy DataFrame: as_of_date, the target's id, the features by name.

        columns: names or glob patterns; what only other columns need isn't computed.
        """
        planner = self.planner
        if columns is not None:
            planner = Planner(self.config, prune=self.columns_matching(columns))
        dates = self._as_of if self._as_of is not None else self.tables("as_of_dates")
        as_of = as_of_frame(self.spark, dates)
        df = Compiler(planner, self.tables, as_of, self.config.get("as_of_boundary", "inclusive")).matrix()
        return imputation.impute(df, self.keys, **options) if impute else df

    def to_groups(self):
        """An ordered dictionary of lazy DataFrames, each with the keys and one group of columns."""
        return OrderedDict((f"group_{i:03d}", self.to_spark(g) if g else self.to_spark()) for i, g in enumerate(self.groups))

    def explain(self, columns=None, mode="formatted"):
        """The physical plan as text."""
        return self.to_spark(columns)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def to_pandas(self, impute=False, **options):
        """The matrix on the driver, indexed by its keys."""
        return self.to_spark(impute=impute, **options).orderBy(AS_OF).toPandas().set_index(self.keys)

    to_dataframe = to_pandas

    def to_arrow(self, numeric_as_float=True, impute=False, **options):
        """The matrix on the driver as an Arrow table; decimals become doubles, or decimal(38,9) if numeric_as_float is false."""
        df = self.to_spark(impute=impute, **options)
        to = T.DoubleType() if numeric_as_float else T.DecimalType(38, 9)
        return df.select(*(q(f.name).cast(to).alias(f.name) if isinstance(f.dataType, T.DecimalType) else q(f.name) for f in df.schema)).orderBy(AS_OF).toArrow()

    def to_parquet(self, path, impute=False, mode="overwrite", grouped=False, **options):
        """Writes the matrix; with ``grouped``, each column group to a folder of its own below ``path``. Returns the paths."""
        if not grouped:
            self.to_spark(impute=impute, **options).write.mode(mode).parquet(str(path))
            return [str(path)]
        out = []
        for name, df in self.to_groups().items():
            df = imputation.impute(df, self.keys, **options) if impute else df
            df.write.mode(mode).parquet(to := f"{str(path).rstrip('/')}/{name}")
            out.append(to)
        return out

    def to_tables(self, schema=None, prefix=None, create_schema=False, impute=False, **options):
        """Saves each column group as a table <prefix>_group_NNN, and the manifest as <prefix>_manifest; returns the names."""
        stem = re.sub(r"\W+", "_", prefix or self.planner.target)
        if schema and create_schema:
            self.spark.sql(f"create schema if not exists `{schema}`")
        at = f"`{schema}`." if schema else ""
        out = []
        for name, df in self.to_groups().items():
            df = imputation.impute(df, self.keys, **options) if impute else df
            df.write.mode("overwrite").saveAsTable(f"{at}`{stem}_{name}`")
            out.append(f"{at}`{stem}_{name}`")
        manifest.to_spark(self.spark, self.manifest).write.mode("overwrite").saveAsTable(f"{at}`{stem}_manifest`")
        return [*out, f"{at}`{stem}_manifest`"]


def merge_groups(frames, keys):
    """Joins column groups on their keys."""
    first, *rest = frames
    for df in rest:
        first = first.join(df, keys, "full_outer")
    return first


def tuned(builder, partitions=None):
    """Session settings that the plans are made for: adaptive execution, exact names, UTC."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.caseSensitive": "true",
        "spark.sql.session.timeZone": "UTC",
        # frames that are partitioned by key alone needn't be shuffled again to be joined by (date, key)
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=conf)


__all__ = ["AS_OF", "Loom", "merge_groups", "tuned"]
