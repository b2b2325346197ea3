import pytest

from asofloom import Loom
from asofloom.model import capped, interval_parts
from asofloom.output import manifest
from asofloom.plans.planner import Planner
from asofloom.plans.validation import problems


def config(**more):
    return {
        "target": "c",
        "max_depth": 2,
        "intervals": ["P6M"],
        "aggregations": ["sum", "count"],
        "transformations": ["identity"],
        "entities": [
            {"alias": "c", "table": "c", "id": "cid", "variables": {"age": "numeric", "name": {"type": "text", "role": "identifier"}}},
            {"alias": "o", "table": "o", "id": "oid", "temporal_ix": "ts", "variables": {"x": "numeric"}},
        ],
        "relationships": [{"parent": {"entity": "c", "key": "cid"}, "child": {"entity": "o", "key": "cid"}}],
    } | more


def names(c):
    return [f.name for f in Planner(c).output]


def test_names():
    with pytest.warns(UserWarning, match="identifier"):
        found = names(config())
    assert found == ["COUNT(o.oid)", "COUNT(o.oid|interval=P6M)", "COUNT(o.ts)", "COUNT(o.ts|interval=P6M)", "SUM(o.x)", "SUM(o.x|interval=P6M)", "age"]


def test_long_names_keep_54_characters():
    a = capped("SUM(" + "é" * 80 + ")")
    assert len(a) == 63 and a[54] == "~" and capped("x" * 63) == "x" * 63


def test_intervals():
    assert interval_parts("P1Y6M") == (18, 0, 0) and interval_parts("P2W") == (0, 14, 0) and interval_parts("PT36H") == (0, 0, 129600)
    for bad in ("", "P", "6M", "P1YT"):
        with pytest.raises(ValueError):
            interval_parts(bad)


def test_depth_bounds_and_cycles():
    assert names(config(max_depth=1)) == ["age"]
    loop = config()
    loop["relationships"].append({"parent": {"entity": "o", "key": "oid"}, "child": {"entity": "c", "key": "oid"}, "name": "back"})
    assert "SUM(o.x)" in names(loop)


def test_missing_vocabulary_raises():
    c = config()
    c["entities"][0]["variables"]["kind"] = {"type": "categorical", "role": "categorical"}
    with pytest.raises(ValueError, match="vocabulary"):
        Planner(c)


def test_empty_layers():
    assert names(config(aggregations=[], transformations=[])) == ["age"]


def test_only_transformed_columns_of_the_target_appear():
    assert "age" not in names(config(transformations=["abs"])) and "ABS(c.age)" in names(config(transformations=["abs"]))


def test_validation_finds_all():
    bad = config(target="q", intervals=["6M"], aggregations=["summ"], as_of_boundary="incl")
    bad["entities"].append({"alias": "c", "table": "c2", "variables": {"v": {"type": "numbr"}}})
    bad["relationships"].append({"parent": {"entity": "c", "key": "cid"}, "child": {"entity": "o", "key": "cid"}})
    text = "\n".join(problems(bad).errors)
    for part in ("target 'q'", "6M", "'summ'; did you mean 'sum'", "as_of_boundary", "twice", "numbr", "parallel"):
        assert part in text
    assert problems({"target": "x"}).errors
    with pytest.raises(ValueError, match="invalid configuration"):
        Loom(bad)


def test_validation_warns():
    c = config(max_depth=9)
    c["relationships"][0]["temporal"] = {"mode": "as_of", "gracee": "P1D"}
    text = "\n".join(problems(c).warnings)
    assert "max_depth 9" in text and "gracee" in text and "as_of needs" in text
    c["relationships"].append({"parent": {"entity": "o", "key": "oid"}, "child": {"entity": "c", "key": "oid"}})
    assert "cycle" in "\n".join(problems(c).warnings)


def test_manifest_and_globs():
    f = Loom(config())
    one = {e.column: e for e in f.manifest}["SUM(o.x|interval=P6M)"]
    assert (one.kind, one.interval, one.depth, one.source_alias, one.parents, one.truncated) == ("derived", "P6M", 1, "o", ("x",), False)
    assert f.columns_matching("SUM(*") == ["SUM(o.x)", "SUM(o.x|interval=P6M)"]
    with pytest.raises(LookupError, match="near"):
        f.columns_matching("sum(o.x)")
    assert manifest.glob_to_like("SUM(*_?%") == "SUM(%\\__\\%"
    assert list(f.manifest_dataframe().columns) == manifest.COLUMNS


def test_cli(tmp_path, capsys):
    import yaml

    from asofloom.cli import main

    assert main(["list-primitives", "-t", "agg", "-s", "gini"]) == 0 and "gini" in capsys.readouterr().out
    assert main(["list-primitives", "-c"]) == 0 and "  - sum" in capsys.readouterr().out
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(config()))
    (tmp_path / "b.yaml").write_text("target: x")
    assert main(["validate", str(tmp_path / "a.yaml")]) == 0
    assert main(["validate", str(tmp_path / "b.yaml")]) == 1 and main(["validate", "/nowhere"]) == 1


def test_registries():
    from asofloom import get_aggregations, register_transformer

    with pytest.raises(KeyError):
        get_aggregations(["nothing"])
    with pytest.raises(ValueError):
        register_transformer("", lambda x: x)
    with pytest.raises(TypeError):
        register_transformer("x", 1)
