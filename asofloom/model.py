"""The relational model: entities, relationships, features and their public names."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace

NAME_BYTES = 63
USER_TYPES = ("numeric", "categorical", "text", "boolean", "date", "timestamp", "index", "vector")
ROLES = ("identifier", "categorical", "numeric")
EDGE_FAMILIES = ("degree", "weighted_degree", "reciprocity", "k_hop_2", "clustering", "common_neighbours", "jaccard", "adamic_adar")
SPATIAL_FAMILIES = ("colocation_count", "distance_to_nearest", "kde_intensity")
NEIGHBOUR_FAMILIES = ("degree", "neighbour_mean", "neighbour_share")


def capped(name: str) -> str:
    """A name of at most 63 bytes: longer ones keep 54 characters and get a hash."""
    if len(name.encode()) <= NAME_BYTES:
        return name
    return f"{name[:54]}~{hashlib.md5(name.encode()).hexdigest()[:8]}"


_INTERVAL = re.compile(r"P(?!$)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?!$)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")


def interval_parts(text: str) -> tuple[int, int, int]:
    """(months, days, seconds) of an ISO-8601 duration."""
    m = _INTERVAL.fullmatch(text or "")
    if not m:
        raise ValueError(f"not an ISO-8601 interval: {text!r}")
    y, mo, w, d, h, mi, s = (int(x or 0) for x in m.groups())
    return 12 * y + mo, 7 * w + d, 3600 * h + 60 * mi + s


@dataclass(frozen=True)
class Feature:
    """A column of the matrix or on the way to it."""

    name: str
    type: str
    entity: str
    label: str = ""
    kind: str = "direct"
    parents: tuple[str, ...] = ()
    source: str = ""
    interval: str | None = None
    value: str | None = None
    definition: str = ""
    depth: int = 0
    predicates: tuple = ()
    role: str | None = None
    vocabulary: tuple | None = None

    @property
    def full(self) -> str:
        return self.label or self.name

    @property
    def predicate(self) -> dict:
        return dict(self.predicates)


@dataclass
class Variable:
    name: str
    type: str
    role: str | None = None
    vocabulary: list | None = None
    predicates: dict = field(default_factory=dict)


@dataclass
class EdgeSpec:
    node: str
    source: str
    target: str
    weight: str | None = None
    timestamp: str | None = None
    features: list[str] = field(default_factory=lambda: ["degree"])


@dataclass
class PeerGroupSpec:
    by: str
    measures: list[str] | None = None


@dataclass
class Entity:
    alias: str
    table: str
    id: str | None = None
    temporal_ix: str | None = None
    lat: str | None = None
    lon: str | None = None
    variables: dict[str, Variable] = field(default_factory=dict)
    edge: EdgeSpec | None = None
    peer_groups: list[PeerGroupSpec] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, c: dict) -> Entity:
        spatial = c.get("spatial_ix") or {}
        variables = {}
        for name, v in (c.get("variables") or {}).items():
            v = v if isinstance(v, dict) else {"type": v}
            role = v.get("role")
            kind = v.get("type") or {"identifier": "index", "categorical": "categorical", "numeric": "numeric"}.get(role, "categorical")
            variables[name] = Variable(name, kind, role, v.get("vocabulary"), dict(v.get("predicates") or {}))
        peers = c.get("peer_groups") or ([c["peer_group"]] if c.get("peer_group") else [])
        edge = c.get("edge")
        return cls(
            alias=c["alias"],
            table=c["table"],
            id=c.get("id"),
            temporal_ix=c.get("temporal_ix"),
            lat=spatial.get("lat") if isinstance(spatial, dict) else None,
            lon=spatial.get("lon") if isinstance(spatial, dict) else None,
            variables=variables,
            edge=EdgeSpec(**{k: v for k, v in edge.items() if v is not None}) if edge else None,
            peer_groups=[PeerGroupSpec(p["by"], p.get("measures")) for p in peers],
        )

    @property
    def carried(self) -> list[str]:
        """Identifier columns that are projected but aren't features."""
        names = [self.id, self.temporal_ix, self.lat, self.lon, *self.keys, *sorted(v.name for v in self.variables.values() if v.type == "index")]
        return list(dict.fromkeys(n for n in names if n))

    @property
    def numeric(self) -> list[str]:
        return sorted(v.name for v in self.variables.values() if v.type == "numeric")

    @property
    def booleans(self) -> list[str]:
        return sorted(v.name for v in self.variables.values() if v.type == "boolean")


@dataclass(frozen=True)
class Relationship:
    parent: str
    child: str
    parent_key: str
    child_key: str
    name: str | None = None
    mode: str | None = None
    grace: str | None = None
    child_timestamp: str | None = None

    @property
    def order(self) -> tuple:
        return self.child, self.child_key, self.parent_key, self.name or "", self.parent


@dataclass
class SpatialSpec:
    name: str
    left: str
    right: str
    within_m: float
    bandwidth_m: float | None = None
    features: list[str] | None = None


@dataclass
class NeighbourSpec:
    name: str
    left: str
    edges: dict
    right: str | None = None
    directed: bool = True
    measures: list[str] | None = None
    shares: list[str] | None = None
    features: list[str] | None = None


class Graph:
    """Entities with the relationships between them."""

    def __init__(self, config: dict):
        self.entities = {e["alias"]: Entity.parse(e) for e in config["entities"]}
        self.relationships = []
        for r in config.get("relationships") or []:
            t = r.get("temporal") or {}
            own = Relationship(r["parent"]["entity"], r["child"]["entity"], r["parent"]["key"], r["child"]["key"], r.get("name"), t.get("mode"), t.get("grace"), t.get("child_timestamp"))
            self.relationships.append(own)
            self.entities[own.child].keys.append(own.child_key)
            self.entities[own.parent].keys.append(own.parent_key)
        self.spatial = [SpatialSpec(**s) for s in config.get("spatial_relationships") or []]
        self.neighbours = [NeighbourSpec(**s) for s in config.get("graph_relationships") or []]

    def forward(self, alias: str) -> list[Relationship]:
        return sorted((r for r in self.relationships if r.child == alias), key=lambda r: r.order)

    def backward(self, alias: str) -> list[Relationship]:
        return sorted((r for r in self.relationships if r.parent == alias), key=lambda r: r.order)

    def edges_of(self, alias: str) -> list[Entity]:
        return [e for e in self.entities.values() if e.edge and e.edge.node == alias]


def qualified(f: Feature, relationship: str) -> Feature:
    """A direct feature under the name of the relationship that it came through."""
    return replace(f, name=capped(f"{relationship}.{f.name}"), label=f"{relationship}.{f.full}")
