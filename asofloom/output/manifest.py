"""What each column of a matrix is, and choosing columns by their labels."""

import difflib
import fnmatch
from dataclasses import asdict, dataclass

COLUMNS = "column label truncated kind entity source_alias depth parents interval source_column value description definition".split()
SCHEMA = "column string, label string, truncated boolean, kind string, entity string, source_alias string, depth int, parents string, interval string, source_column string, value string, description string, definition string"


@dataclass(frozen=True)
class Entry:
    column: str
    label: str
    truncated: bool
    kind: str  # variable, one_hot or derived
    entity: str
    source_alias: str | None
    depth: int
    parents: tuple
    interval: str | None
    source_column: str | None
    value: str | None
    description: str
    definition: str

    def as_dict(self):
        return asdict(self)


def build(features):
    """One entry for each feature of the output."""
    return [_entry(f) for f in features]


def _entry(f):
    kind = f.kind if f.kind in ("variable", "one_hot") else "derived"
    if kind == "variable":
        text = f"{f.name} of {f.entity}"
    elif kind == "one_hot":
        text = f"1 where {f.source} of {f.entity} is {f.value}"
    else:
        window = f" over the {f.interval} before the as-of date" if f.interval else ""
        text = f"{f.definition or f.kind} of {', '.join(f.parents) or f.entity}{window}"
    return Entry(f.name, f.full, f.name != f.full, kind, f.entity, f.source if kind == "derived" else None, f.depth, tuple(f.parents), f.interval, f.source if kind == "one_hot" else None, f.value, text, f.definition)


def rows(entries):
    """The entries as rows of COLUMNS, parents joined by commas."""
    return [tuple(", ".join(e.parents) if c == "parents" else getattr(e, c) for c in COLUMNS) for e in entries]


def to_pandas(entries):
    import pandas as pd

    return pd.DataFrame(rows(entries), columns=COLUMNS)


def to_spark(spark, entries):
    return spark.createDataFrame(rows(entries), SCHEMA)


def matching(entries, patterns):
    """The entries whose label or column fits any of the glob patterns, case counted; LookupError with near names if none does."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    found = []
    for p in patterns:
        own = [e for e in entries if fnmatch.fnmatchcase(e.label, p) or fnmatch.fnmatchcase(e.column, p)]
        if not own:
            near = difflib.get_close_matches(p, [e.label for e in entries], 3, 0.3)
            raise LookupError(f"no column fits {p!r}" + (f"; near: {', '.join(near)}" if near else ""))
        found += [e for e in own if e not in found]
    return found


def glob_to_like(pattern):
    """A glob as a SQL LIKE pattern with backslash as escape; sets in brackets have no counterpart and raise ValueError."""
    if "[" in pattern:
        raise ValueError("LIKE has no sets: " + pattern)
    out = []
    for ch in pattern:
        out.append({"*": "%", "?": "_"}.get(ch) or ("\\" + ch if ch in "%_\\" else ch))
    return "".join(out)
