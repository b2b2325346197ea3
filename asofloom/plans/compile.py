"""A feature plan as one lazy DataFrame.

An entity's frame has its identifiers and features. It has no as-of date until something in it depends on one: row-wise work is done once,
however many dates there are. The dates are few and are broadcast.
"""

from pyspark.sql import functions as F

from ..boundary import AS_OF, known, q
from ..functions.aggregations import Child, Scope, aggregate, flagged, prepare
from ..functions.transformations import Rows
from ..operators import graph, neighbours, peers, spatial
from ..operators.joins import as_of_join, transfer
from ..operators.ranks import population_rank, population_scores
from .planner import Aggregate, Direct, Planner

PASSES = {"graph": graph.features, "peers": peers.features, "spatial": spatial.features, "neighbours": neighbours.features}


def as_of_frame(spark, dates):
    """The as-of dates as a DataFrame of distinct dates (or timestamps): a DataFrame with as_of_date, or a list."""
    if hasattr(dates, "select"):
        return dates.select(AS_OF).where(q(AS_OF).isNotNull()).distinct()
    rows = [(str(d),) for d in dict.fromkeys(dates)]
    frame = spark.createDataFrame(rows, f"{AS_OF} string")
    return frame.select(q(AS_OF).cast("date" if all(len(d[0]) == 10 for d in rows) else "timestamp_ntz").alias(AS_OF))


class Compiler:
    def __init__(self, planner: Planner, tables, as_of, boundary="inclusive"):
        self.planner, self.tables, self.mode = planner, tables, boundary
        self.as_of = F.broadcast(as_of)
        self.frames = {}

    def matrix(self):
        """as_of_date and the target's id, then the features by name."""
        for alias in self.planner.order:
            if alias not in self.frames:
                self.frames[alias] = self._frame(self.planner.plans[alias])
        plan = self.planner.plans[self.planner.target]
        df = self.dated(self.frames[self.planner.target])
        ids = [plan.entity.id] if plan.entity.id else []
        return df.select(q(AS_OF), *map(q, ids), *(q(f.name) for f in self.planner.output))

    def dated(self, df, ts=None):
        """A frame with as-of dates; with ``ts``, only what is known at each."""
        df = df if AS_OF in df.columns else df.crossJoin(self.as_of)
        return df.where(known(q(ts), mode=self.mode)) if ts else df

    def base(self, entity, extra=()):
        """An entity's table: identifiers, variables, and other columns by name."""
        df = self.tables(entity.table)
        columns = []
        for c in dict.fromkeys([*entity.carried, *(v.name for v in entity.variables.values()), *extra]):
            kind = entity.variables[c].type if c in entity.variables else None
            columns.append((q(c).cast("double") if kind == "numeric" else q(c).cast("string") if kind in ("categorical", "text") else q(c)).alias(c))
        return df.select(*columns)

    def _frame(self, plan):
        e = plan.entity
        extra = [s.relationship.child_timestamp for s in plan.inputs if isinstance(s, Direct) and s.relationship.child_timestamp]
        df = self.base(e, extra)
        for step in plan.inputs:
            if isinstance(step, Direct):
                df = self._direct(df, e, step)
            elif isinstance(step, Aggregate):
                df = self._aggregates(df, step)
            else:
                own = PASSES[step.kind](self, e, step.spec, step.columns)
                df = self._attach(df, own, e.id, "__node")
        return self._transformed(df, plan)

    def _attach(self, df, own, key, own_key):
        """A left join on the key, and on the as-of date where the right side has one."""
        if AS_OF in own.columns:
            df = self.dated(df)
            own = own.withColumnRenamed(AS_OF, "__as_of")
            return df.join(own, (q(key) == q(own_key)) & (q(AS_OF) == q("__as_of")), "left").drop(own_key, "__as_of")
        return df.join(own, q(key) == q(own_key), "left").drop(own_key)

    def _direct(self, df, entity, step):
        r = step.relationship
        parent, p = self.frames[r.parent], self.planner.graph.entities[r.parent]
        if AS_OF in parent.columns:
            df = self.dated(df)
        ts = r.child_timestamp or entity.temporal_ix
        if r.mode == "as_of" and p.temporal_ix and ts:
            return as_of_join(df, parent, r.child_key, r.parent_key, ts, p.temporal_ix, step.columns, r.grace, tiebreak=p.id)
        return transfer(df, parent, r.child_key, r.parent_key, step.columns)

    def _aggregates(self, df, step):
        r = step.relationship
        rows, e = self.frames[r.child], self.planner.graph.entities[r.child]
        rows = rows.where(q(r.child_key).isNotNull())
        child = Child(r.child_key, e.temporal_ix, e.lat, e.lon, [e.id, *sorted(v.name for v in e.variables.values())], self.mode, rows.columns)
        wanted = [(n, a, Scope(child, f.name, f.type, i, f.predicate)) for n, a, f, i in step.wanted]
        rows = rows.select("*", *prepare(wanted, child))
        if e.temporal_ix:
            rows = flagged(self.dated(rows, e.temporal_ix), child, wanted)
        own = aggregate(rows, child, wanted).withColumnRenamed(r.child_key, "__key")
        return self._attach(df, own, r.parent_key, "__key")

    def _transformed(self, df, plan):
        e, target = plan.entity, plan.entity.alias == self.planner.target
        used = {t.name: t for _, t, _, _ in plan.outputs if t is not None}
        if any(t.future for t in used.values()):
            # what looks beyond a row may only see what is known; a target's rows are there at every date
            df = self.dated(df, None if target else e.temporal_ix)
        rows = Rows(e.id, e.temporal_ix, AS_OF in df.columns, [v.name for v in sorted(e.variables.values(), key=lambda v: v.name) if v.name in df.columns])
        scope = [AS_OF] if AS_OF in df.columns else []
        base = df
        for name, add in (("cross_entity_zscore", population_scores), ("cross_entity_percentile", population_rank)):
            for f, t, source, _ in plan.outputs:
                if t is not None and t.name == name:
                    df = add(df, source.name, scope, f"__{f.name}", base)
        columns = {c: q(c) for c in [*scope, *e.carried]}
        if not target:
            # all variables: they break ties of time wherever order matters, so pruning doesn't change a result
            columns |= {n: q(n) for n in [*e.variables, *plan.synth]}
        for f, t, source, k in plan.outputs:
            if f.kind == "one_hot":
                columns[f.name] = F.when(q(source.name).cast("string") == f.value, 1).otherwise(0)
            elif t is None:
                columns[f.name] = q(f.name)
            elif f"__{f.name}" in df.columns:
                columns[f.name] = q(f"__{f.name}")
            else:
                x = t(q(source.name), rows)
                columns[f.name] = x[k] if isinstance(x, tuple) else x
        return df.select(*(c.alias(n) for n, c in columns.items()))
