"""What all bridges share: causal fitting, snapshots by as-of date, saving, and the configuration that joins the result."""

from functools import reduce

from pyspark.sql import functions as F

from ..boundary import AS_OF, q


def known_rows(rows, as_of, ts):
    """The rows that were there at a date; a row without a time wasn't."""
    return rows.where(q(ts) <= F.lit(as_of))


def assert_known(rows, as_of, ts):
    """Raises ValueError if a model would be fitted on a row later than its date."""
    late = rows.where(q(ts) > F.lit(as_of)).select(q(ts)).limit(1).collect()
    if late:
        raise ValueError(f"rows to be fitted on reach beyond {as_of}: {ts} = {late[0][0]}")


def assert_vintage(bridge, as_of):
    """Raises ValueError unless a pretrained model is known to be older than a date."""
    if bridge.model_vintage is None:
        raise ValueError(f"{bridge.name}: nobody knows how old its model is; set model_vintage")
    if str(bridge.model_vintage) > str(as_of):
        raise ValueError(f"{bridge.name}: its model of {bridge.model_vintage} is younger than {as_of}")


class Bridge:
    """Subclasses set ``values`` ({column: feature type}) and define compute(rows, fit_rows): a DataFrame of a key and these columns."""

    name = "bridge"
    values: dict = {}
    model_vintage = None

    def compute(self, rows, fit_rows):
        raise NotImplementedError

    def run(self, rows, fit_before=None, ts=None):
        """compute(), fitted on the rows up to ``fit_before`` only."""
        if fit_before is None:
            return self.compute(rows, rows)
        fit = known_rows(rows, fit_before, ts)
        return self.compute(rows, fit)

    def snapshots(self, rows, as_of_dates, ts, date_column=AS_OF):
        """compute() anew for each date from what was known at it: for measures that one later row would change everywhere."""
        parts = []
        for d in sorted(as_of_dates, key=str):
            then = known_rows(rows, d, ts)
            parts.append(self.compute(then, then).withColumn(date_column, F.lit(str(d)).cast("date")))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def save(self, df, table, persist=False):
        """Registers the result as a temporary view, or saves it as a table."""
        if persist:
            df.write.mode("overwrite").saveAsTable(table)
        else:
            df.createOrReplaceTempView(table)
        return table

    def config(self, table, id, parent, parent_key, key, temporal_ix=None):
        """The entity and the relationship that join the saved result to a configuration."""
        entity = {"alias": self.name, "table": table, "id": id, "variables": {c: {"type": t} for c, t in self.values.items()}}
        if temporal_ix:
            entity["temporal_ix"] = temporal_ix
        return {"entity": entity, "relationship": {"parent": {"entity": parent, "key": parent_key}, "child": {"entity": self.name, "key": key}}}
