"""Depth-first feature synthesis: which features each entity has, and from what. Nothing here touches Spark.

An entity is planned once, after all that it reads: parents (direct features) and children (aggregations) first, then its graph, peer,
spatial and neighbour features, then transformations. A relationship to an entity that is still being planned closes a cycle and is left.
"""

import logging
import warnings
from dataclasses import dataclass, field, replace

from ..functions import aggregations as _aggregations  # noqa: F401 - registers the primitives
from ..functions import transformations as _transformations  # noqa: F401
from ..functions.registry import get_aggregations, get_transformers
from ..model import EDGE_FAMILIES, NEIGHBOUR_FAMILIES, SPATIAL_FAMILIES, Entity, Feature, Graph, Relationship, capped

log = logging.getLogger(__name__)

AGGREGATIONS = ("count", "mean", "sum", "stddev", "min", "max", "median", "nunique", "recency", "tenure")
TRANSFORMATIONS = (
    "identity abs cum_sum day dow month lag_1 lag_3 lag_7 rolling_mean_3 rolling_std_7 rolling_median_7 rolling_iqr_7 ema_7 holt_winters_level_7 holt_winters_trend_7 pct_change_1"
).split()
#: Values of a vocabulary above which one-hot encoding warns.
WIDE_VOCABULARY = 25


@dataclass
class Direct:
    """Columns that a parent's row lends to its children's rows."""

    relationship: Relationship
    columns: list  # (name in the parent's frame, name here)


@dataclass
class Aggregate:
    """Aggregations of a child's rows."""

    relationship: Relationship
    wanted: list  # (name, aggregation, feature of the child, interval)


@dataclass
class Pass:
    """Columns of a graph, peer, spatial or neighbour pass."""

    kind: str
    spec: object
    columns: list  # (family, detail, name)


@dataclass
class EntityPlan:
    entity: Entity
    inputs: list = field(default_factory=list)
    synth: dict = field(default_factory=dict)  # name -> Feature before transformation
    outputs: list = field(default_factory=list)  # (Feature, transformation or None, source Feature, suffix number)

    @property
    def features(self):
        """What a reader of this entity may use: all columns, transformed or not, and the indexes."""
        out = dict(self.synth) | {f.name: f for f, *_ in self.outputs}
        return sorted([*self.indexes, *(f for f in out.values())], key=lambda f: f.name)

    @property
    def indexes(self):
        e = self.entity
        names = dict.fromkeys(n for n in [e.id, e.temporal_ix, *(v.name for v in e.variables.values() if v.type == "index")] if n)
        return [Feature(n, "index", e.alias, kind="index") for n in names]


class Planner:
    def __init__(self, config: dict, prune=None):
        """prune: names of output columns; others aren't planned on the target, and what only they need isn't computed."""
        self.graph = Graph(config)
        self.max_depth, self.intervals = config["max_depth"], list(config.get("intervals") or [])
        self.aggregations = get_aggregations(AGGREGATIONS if config.get("aggregations") is None else config["aggregations"])
        self.transformations = get_transformers(TRANSFORMATIONS if config.get("transformations") is None else config["transformations"])
        if config["target"] not in self.graph.entities:
            raise ValueError(f"unknown target entity: {config['target']}")
        self.target = config["target"]
        self.plans: dict[str, EntityPlan] = {}
        self.begun: set[str] = set()
        self.order: list[str] = []
        self._entity(self.target, 0)
        self.prune(prune)

    def _entity(self, alias, depth):
        depth += 1
        self.begun.add(alias)
        e = self.graph.entities[alias]
        plan = EntityPlan(e)
        for v in e.variables.values():
            if v.type != "index":
                plan.synth[v.name] = Feature(v.name, v.type, alias, kind="variable", predicates=tuple(sorted(v.predicates.items())), role=v.role, vocabulary=tuple(sorted(v.vocabulary)) if v.vocabulary else None)
        if depth < self.max_depth:
            for r in self.graph.forward(alias):
                if r.parent not in self.begun:
                    self._entity(r.parent, depth)
                if r.parent in self.plans:
                    self._direct(plan, r)
            for r in self.graph.backward(alias):
                if r.child not in self.begun:
                    self._entity(r.child, depth)
                if r.child in self.plans:
                    self._aggregate(plan, r)
        self._passes(plan)
        self._transform(plan)
        self.plans[alias] = plan
        self.order.append(alias)

    def _add(self, plan, feature):
        """A synth feature; a name that is taken gets its source entity before it."""
        if feature.name in plan.synth or feature.name in plan.entity.carried:
            feature = replace(feature, name=capped(f"{feature.source}.{feature.name}"), label=f"{feature.source}.{feature.full}")
        plan.synth[feature.name] = feature
        return feature.name

    def _direct(self, plan, r):
        parent = self.plans[r.parent]
        if parent.entity.id is None and r.mode != "as_of":
            return
        columns = []
        for f in parent.features:
            if f.type in ("index", "key") or f.role == "identifier":
                continue
            own = replace(f, kind="direct", source=r.name or r.parent, parents=(f.full,), role=None)
            if r.name:
                own = replace(own, name=capped(f"{r.name}.{f.name}"), label=f"{r.name}.{f.full}")
            columns.append((f.name, self._add(plan, own)))
        if columns:
            plan.inputs.append(Direct(r, columns))

    def _aggregate(self, plan, r):
        child = self.plans[r.child]
        alias, wanted = r.name or r.child, []
        for f in child.features:
            if f.type == "key":
                continue
            for name, a in self.aggregations.items():
                for i in [None, *(self.intervals if child.entity.temporal_ix else [])]:
                    if not a.applies(f, child.entity, i):
                        continue
                    tail = f"|interval={i})" if i else ")"
                    full = f"{name.upper()}({alias}.{f.full}{tail}"
                    own = Feature(capped(f"{name.upper()}({alias}.{f.name}{tail}"), a.output_type(f), plan.entity.alias, full, "aggregation", (f.full,), alias, i, depth=f.depth + 1, definition=a.doc)
                    wanted.append((self._add(plan, own), a, f, i))
        if wanted:
            plan.inputs.append(Aggregate(r, wanted))

    def _passes(self, plan):
        e = plan.entity
        found = []
        for edge in self.graph.edges_of(e.alias):
            unknown = set(edge.edge.features) - set(EDGE_FAMILIES)
            if unknown:
                raise ValueError(f"unknown edge features: {sorted(unknown)}")
            label = lambda m, edge=edge: f"{m}({e.alias}.{edge.alias})"
            names = []
            for family in edge.edge.features:
                names += [(family, m, label(m)) for m in _edge_metrics(family, edge.edge) if (m not in {n[1] for n in names})]
            found.append(("graph", edge, names))
        for spec in e.peer_groups:
            names = [("size", None, f"PEER_GROUP_SIZE({e.alias} by {spec.by})")]
            for m in spec.measures if spec.measures is not None else e.numeric:
                names += [(k, m, f"{k.upper()}({e.alias}.{m} by {spec.by})") for k in ("peer_mean", "ego_minus_peer_mean", "peer_zscore", "peer_pctile")]
            names += [("peer_event_rate", r, f"PEER_EVENT_RATE({e.alias}.{r.child} by {spec.by})") for r in self.graph.backward(e.alias)]
            found.append(("peers", spec, names))
        for spec in self.graph.spatial:
            if spec.left == e.alias:
                found.append(("spatial", spec, [(f, None, f"{f.upper()}({spec.name})") for f in spec.features or SPATIAL_FAMILIES]))
        for spec in self.graph.neighbours:
            if spec.left == e.alias:
                right = self.graph.entities[spec.right or spec.left]
                wanted = spec.features or NEIGHBOUR_FAMILIES
                names = [("degree", i, f"DEGREE({spec.name}{f'|interval={i}' if i else ''})") for i in [None, *self.intervals]] if "degree" in wanted else []
                if right.id:
                    if "neighbour_mean" in wanted:
                        names += [("neighbour_mean", m, f"NEIGHBOUR_MEAN({spec.name}.{m})") for m in (right.numeric if spec.measures is None else spec.measures)]
                    if "neighbour_share" in wanted:
                        names += [("neighbour_share", m, f"NEIGHBOUR_SHARE({spec.name}.{m})") for m in (right.booleans if spec.shares is None else spec.shares)]
                found.append(("neighbours", spec, names))
        for kind, spec, names in found:
            if not e.id:
                log.warning("%s has no id: its %s features are left out", e.alias, kind)
                continue
            columns = [(f, d, self._add(plan, Feature(capped(n), "numeric", e.alias, n, kind, source=e.alias, depth=1))) for f, d, n in names]
            plan.inputs.append(Pass(kind, spec, columns))

    def _transform(self, plan):
        e, target = plan.entity, plan.entity.alias == self.target
        taken = {}

        def out(feature, transformation, source, k=0):
            if feature.name not in taken and feature.name not in e.carried:
                taken[feature.name] = (feature, transformation, source, k)

        for f in list(plan.synth.values()):
            if target and f.kind == "variable" and f.role == "identifier":
                warnings.warn(f"{e.alias}.{f.name} is an identifier and no feature", stacklevel=2)
                continue
            if target and f.kind == "variable" and f.role == "categorical":
                if not f.vocabulary:
                    raise ValueError(f"{e.alias}.{f.name} has role categorical but no vocabulary; declare one, as learning it from the data would leak")
                if len(f.vocabulary) > WIDE_VOCABULARY:
                    warnings.warn(f"{e.alias}.{f.name} becomes {len(f.vocabulary)} columns", stacklevel=2)
                for v in f.vocabulary:
                    full = f"{e.alias}.{f.name}={v}"
                    out(Feature(capped(full), "numeric", e.alias, full, "one_hot", (f.name,), f.name, value=str(v), depth=1), None, f)
                continue
            if target and f.kind == "variable" and f.role is None and f.type in ("text", "categorical"):
                log.warning("%s.%s stays a string; a role makes it one-hot columns or leaves it out", e.alias, f.name)
            if not self.transformations:
                out(f, None, f)
            for name, t in self.transformations.items():
                if name == "identity" or not t.applies(f):
                    out(f, None, f)
                    continue
                if t.windowed and not (e.id and e.temporal_ix):
                    continue
                for k, suffix in enumerate(t.suffixes or [""]):
                    n = f"{name.upper()}{suffix}({e.alias}.{f.name})"
                    full = f"{name.upper()}{suffix}({e.alias}.{f.full})"
                    out(Feature(capped(n), t.output_type(f), e.alias, full, "transformation", (f.full,), e.alias, depth=f.depth + 1, definition=t.doc), t, f, k)
        plan.outputs = sorted(taken.values(), key=lambda x: x[0].name)

    def prune(self, names):
        """Keeps only what the named target columns need, down to the leaves."""
        if names is None:
            return
        wanted = {self.target: set(names)}
        for alias in reversed(self.order):
            plan, own = self.plans[alias], wanted.get(alias, set())
            plan.outputs = [o for o in plan.outputs if o[0].name in own]
            used = {o[2].name for o in plan.outputs} | own
            inputs = []
            for step in plan.inputs:
                if isinstance(step, Direct):
                    step.columns = [c for c in step.columns if c[1] in used]
                    wanted.setdefault(step.relationship.parent, set()).update(c[0] for c in step.columns)
                    keep = step.columns
                elif isinstance(step, Aggregate):
                    step.wanted = [w for w in step.wanted if w[0] in used]
                    wanted.setdefault(step.relationship.child, set()).update(w[2].name for w in step.wanted)
                    keep = step.wanted
                else:
                    step.columns = [c for c in step.columns if c[2] in used]
                    keep = step.columns
                inputs += [step] if keep else []
            plan.inputs = inputs
            plan.synth = {n: f for n, f in plan.synth.items() if n in used}

    @property
    def output(self):
        """The target's features, ordered by name."""
        return [f for f, *_ in self.plans[self.target].outputs]


def _edge_metrics(family, edge):
    if family == "degree":
        return ["OUT_DEGREE", "IN_DEGREE", "DEGREE"] + (["WEIGHTED_OUT_DEGREE", "WEIGHTED_IN_DEGREE"] if edge.weight else [])
    if family == "weighted_degree":
        return ["WEIGHTED_OUT_DEGREE", "WEIGHTED_IN_DEGREE"]
    return [{"reciprocity": "RECIPROCITY", "k_hop_2": "K_HOP_2_COUNT", "clustering": "CLUSTERING_COEFF", "common_neighbours": "COMMON_NEIGHBOURS_MEAN", "jaccard": "JACCARD_MEAN", "adamic_adar": "ADAMIC_ADAR_MEAN"}[family]]
