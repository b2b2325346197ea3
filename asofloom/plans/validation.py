"""Checks of a configuration before anything is planned.

``problems`` returns all errors and warnings; ``check`` raises ValueError with the errors and warns of the rest.
"""

import difflib
import warnings

from ..boundary import MODES
from ..functions.registry import AGGREGATIONS, TRANSFORMATIONS
from ..model import EDGE_FAMILIES, NEIGHBOUR_FAMILIES, ROLES, SPATIAL_FAMILIES, USER_TYPES, interval_parts

REQUIRED = ("target", "max_depth", "intervals", "entities")
KNOWN = {*REQUIRED, "relationships", "aggregations", "transformations", "as_of_boundary", "spatial_relationships", "graph_relationships"}
DEEP, MANY_INTERVALS = 5, 10


def hint(word, known):
    close = difflib.get_close_matches(str(word), [str(k) for k in known], 1)
    return f"; did you mean {close[0]!r}?" if close else ""


class Report:
    def __init__(self):
        self.errors, self.warnings = [], []

    def need(self, fine, text):
        if not fine:
            self.errors.append(text)
        return fine

    def one_of(self, value, known, what):
        return self.need(value in known, f"{what}: {value!r} isn't one of {', '.join(map(str, known))}{hint(value, known)}")

    def interval(self, value, where):
        try:
            interval_parts(value)
        except (ValueError, TypeError):
            self.errors.append(f"{where}: {value!r} is no ISO-8601 interval such as P6M or P7D")


def problems(c) -> Report:
    from ..functions import aggregations, transformations  # noqa: F401 - registers the primitives

    r = Report()
    for k in REQUIRED:
        r.need(k in c, f"missing key: {k}{hint(k, c)}")
    for k in c:
        if k not in KNOWN:
            r.warnings.append(f"unknown key: {k}{hint(k, KNOWN)}")
    if r.errors:
        return r
    r.need(isinstance(c["max_depth"], int) and not isinstance(c["max_depth"], bool) and c["max_depth"] >= 1, "max_depth must be a whole number of at least 1")
    if r.need(isinstance(c["intervals"] or [], list), "intervals must be a list"):
        for i in c["intervals"] or []:
            r.interval(i, "intervals")
        if len(c["intervals"] or []) > MANY_INTERVALS:
            r.warnings.append(f"{len(c['intervals'])} intervals multiply the columns")
    if isinstance(c["max_depth"], int) and c["max_depth"] > DEEP:
        r.warnings.append(f"max_depth {c['max_depth']} makes very many features")
    r.one_of(c.get("as_of_boundary", MODES[0]), MODES, "as_of_boundary")
    for key, registry in (("aggregations", AGGREGATIONS), ("transformations", TRANSFORMATIONS)):
        for name in c.get(key) or []:
            r.need(name in registry.items, f"{key}: unknown primitive {name!r}{hint(name, registry.items)}")
    if not r.need(isinstance(c["entities"], list) and c["entities"], "entities must be a list with at least one entity"):
        return r
    aliases = {}
    for k, e in enumerate(c["entities"]):
        _entity(r, e, k, aliases)
    r.need(c["target"] in aliases, f"target {c['target']!r} is no entity{hint(c['target'], aliases)}")
    for e in aliases.values():
        if e.get("edge"):
            _edge(r, e, aliases)
    edges = [_relationship(r, x, k, aliases) for k, x in enumerate(c.get("relationships") or [])]
    _names(r, c.get("relationships") or [], aliases)
    _cycles(r, [e for e in edges if e])
    for s in c.get("spatial_relationships") or []:
        _second_table(r, s, aliases, ("name", "left", "right", "within_m"), SPATIAL_FAMILIES, "spatial_relationships")
        if "within_m" in s:
            r.need(isinstance(s["within_m"], int | float) and s["within_m"] > 0, f"spatial_relationships {s.get('name')}: within_m must be positive")
    for s in c.get("graph_relationships") or []:
        _second_table(r, s, aliases, ("name", "left", "edges"), NEIGHBOUR_FAMILIES, "graph_relationships")
        for k in ("table", "source", "target", "timestamp"):
            r.need(k in (s.get("edges") or {}), f"graph_relationships {s.get('name')}: edges lacks {k}")
    return r


def _entity(r, e, k, aliases):
    if not r.need(isinstance(e, dict) and e.get("alias"), f"entity {k} needs an alias"):
        return
    a = e["alias"]
    r.need(a not in aliases, f"entity alias {a!r} is there twice")
    aliases[a] = e
    r.need(bool(e.get("table")), f"{a}: needs a table")
    variables = e.get("variables") or {}
    if not r.need(isinstance(variables, dict), f"{a}: variables must map names to types"):
        return
    for name, v in variables.items():
        v = v if isinstance(v, dict) else {"type": v}
        if v.get("role") is not None:
            r.one_of(v["role"], ROLES, f"{a}.{name} role")
        if r.need("type" in v or "role" in v, f"{a}.{name}: needs a type") and "type" in v:
            r.one_of(v["type"], USER_TYPES, f"{a}.{name} type")
        words = v.get("vocabulary")
        if words is not None:
            r.need(isinstance(words, list) and words and len(set(map(str, words))) == len(words), f"{a}.{name}: vocabulary must be a list of distinct values")
    peers = e.get("peer_groups") or ([e["peer_group"]] if e.get("peer_group") else [])
    for p in peers:
        if r.need(isinstance(p, dict) and p.get("by"), f"{a}: a peer group needs by"):
            r.need(p["by"] in variables or p["by"] == e.get("id"), f"{a}: peer group by {p['by']!r} is no variable{hint(p['by'], variables)}")
            for m in p.get("measures") or []:
                r.need(m in variables, f"{a}: peer measure {m!r} is no variable{hint(m, variables)}")


def _edge(r, e, aliases):
    x = e["edge"]
    for k in ("node", "source", "target"):
        r.need(k in x, f"{e['alias']}: edge lacks {k}")
    if "node" in x:
        r.need(x["node"] in aliases, f"{e['alias']}: edge node {x['node']!r} is no entity{hint(x['node'], aliases)}")
    for f in x.get("features") or []:
        r.one_of(f, EDGE_FAMILIES, f"{e['alias']} edge features")


def _relationship(r, x, k, aliases):
    where = f"relationship {x.get('name') or k}"
    fine = True
    for side in ("parent", "child"):
        s = x.get(side) or {}
        fine &= r.need("entity" in s and "key" in s, f"{where}: {side} needs entity and key")
        if "entity" in s:
            fine &= r.need(s["entity"] in aliases, f"{where}: {s['entity']!r} is no entity{hint(s['entity'], aliases)}")
    t = x.get("temporal")
    if t:
        for key in t:
            if key not in ("mode", "grace", "child_timestamp"):
                r.warnings.append(f"{where}: unknown temporal key {key!r}")
        if "mode" in t:
            r.one_of(t["mode"], ("as_of",), f"{where} temporal mode")
        if t.get("grace"):
            r.interval(t["grace"], f"{where} grace")
        if fine and t.get("mode") == "as_of":
            p, c = aliases[x["parent"]["entity"]], aliases[x["child"]["entity"]]
            if not p.get("temporal_ix") or not (c.get("temporal_ix") or t.get("child_timestamp")):
                r.warnings.append(f"{where}: as_of needs a temporal_ix on both sides; it is joined as a static one")
    return (x["parent"]["entity"], x["child"]["entity"]) if fine else None


def _names(r, relationships, aliases):
    seen, pairs = set(), {}
    for x in relationships:
        name = x.get("name")
        pair = tuple((x.get(s) or {}).get("entity") for s in ("parent", "child"))
        pairs.setdefault(pair, []).append(name)
        if name is not None:
            r.need(str(name).isidentifier(), f"relationship name {name!r} is no identifier")
            r.need(name not in seen, f"relationship name {name!r} is there twice")
            r.need(name not in aliases, f"relationship name {name!r} is an entity's alias")
            seen.add(name)
    for pair, names in pairs.items():
        r.need(len(names) < 2 or None not in names, f"parallel relationships {pair[0]} - {pair[1]} need names")


def _cycles(r, edges):
    children = {}
    for p, c in edges:
        children.setdefault(p, set()).add(c)
    state = {}

    def visit(n, path):
        state[n] = 1
        for m in sorted(children.get(n, ())):
            if state.get(m) == 1:
                r.warnings.append(f"relationships form a cycle: {' - '.join([*path, n, m])}")
            elif m not in state:
                visit(m, [*path, n])
        state[n] = 2

    for n in sorted(children):
        if n not in state:
            visit(n, [])


def _second_table(r, s, aliases, needed, families, what):
    for k in needed:
        r.need(k in s, f"{what} {s.get('name')}: lacks {k}")
    for k in ("left", "right"):
        if s.get(k):
            r.need(s[k] in aliases, f"{what} {s.get('name')}: {k} {s[k]!r} is no entity{hint(s[k], aliases)}")
    for f in s.get("features") or []:
        r.one_of(f, families, f"{what} {s.get('name')} features")


def check(c):
    found = problems(c)
    for w in found.warnings:
        warnings.warn(w, stacklevel=3)
    if found.errors:
        raise ValueError("invalid configuration:\n" + "\n".join(f"- {e}" for e in found.errors))
