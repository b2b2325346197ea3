"""The pipeline's stages against plain versions of their decisions (plain.py), which share no code with the operators but the fitted model."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from asofloom.llm import langid, simhash, token_counts, toxicity
from tests.conftest import SF

from . import plain
from .test_operators import RANKS, check_packs


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        given = spark.createDataFrame(stage(spark, given, SF).toPandas())
        out[name] = given
    ids = lambda name: {r["doc_id"] for r in out[name].collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert max(collections.Counter(r["lang"] for r in rows.values()).values()) <= langid.FIT_DOCS  # so all of them are the sample
    model = plain.language_model([(r["text"], r["lang"]) for r in rows.values() if r["text"] is not None and r["lang"] is not None])
    kept = {i for i, r in rows.items() if plain.language(model, r["text"])[0] != "und"}
    assert ids("language_id") == kept and all(out[n].columns == docs.columns for n in list(out)[:-1])
    model = toxicity.fit_on(out["language_id"], labels)
    score = {i: plain.toxic_score(model, rows[i]["text"]) for i in kept}
    cut = {i: model["thresholds"].get(rows[i]["lang"], model["common"]) for i in kept}
    sure = {i for i in kept if abs(score[i] - cut[i]) > 1e-4}
    assert len(sure) >= len(kept) - 2 and {i for i in sure if score[i] < cut[i]} == ids("toxicity") & sure and any(score[i] >= cut[i] for i in sure)
    kept = ids("toxicity")
    kept = {i for i, g in plain.groups({i: rows[i]["text"] for i in kept}).items() if i == g}
    assert ids("near_dedup") == kept and kept < ids("toxicity")
    runs = set().union(*(plain.runs(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    assert ids("decontamination") == {i for i in kept if not plain.leaks(rows[i]["text"], runs)} < kept
    own = token_counts.encoding(RANKS)
    check_packs(out["packing"].collect(), {i: len(own.encode_ordinary(rows[i]["text"])) for i in ids("decontamination")}, 2048)


def test_run_on_an_empty_corpus(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_odd_rows(spark, tmp_path, odd):
    """Nulls in every column, repeated rows, clashing columns, very long texts: each stage keeps what is no reason to drop."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {c: F.lit("clash") for c in ("score", "toxic", "group_id", "n_tokens", "start", "pack_id", "__id", "h", "t", "i", "y")}
    english = "the people of the house and the story of it that was told to them in a long and quiet winter by the old man"
    more = [(None, english, None, None, None), (None, english, "en", "s", 1), (9001, english, None, None, None), (9001, english, None, None, None), (9002, english, "en", None, 1), (9003, f"{english} " * 6000, None, "s", None), (9004, None, "en", "s", 1), (9005, "", None, "s", 1)]
    every = docs.unionByName(odd.select(F.col("doc_id") + 9100, *docs.columns[1:]).toDF(*docs.columns)).union(spark.createDataFrame(more, docs.schema)).withColumns(clash)
    every.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    given, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        given = spark.createDataFrame(stage(spark, given, str(tmp_path)).toArrow())
        seen[name] = collections.Counter(r["doc_id"] for r in given.collect())
        assert given.columns == every.columns
    assert seen["language_id"][9001] == 2 and seen["language_id"][None] >= 2 and {9002, 9003, 9106} <= set(seen["language_id"])
    assert not {9004, 9005, 9101, 9102, 9103, 9107} & set(seen["language_id"])
    assert seen["near_dedup"][9001] == 1 and seen["near_dedup"][9002] == 0 and seen["near_dedup"][None] == seen["toxicity"][None] >= 2
    packs = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = token_counts.encoding(RANKS)
    want = collections.Counter()
    for r in given.collect():
        want[r["doc_id"]] += len(own.encode_ordinary(r["text"]))
    check_packs(packs, want, 2048)
    assert want[None]
    # the classifier alone, fitted on few labels here, may drop the very long text
    assert (9106 in seen["toxicity"]) == (9106 in seen["near_dedup"]) == (9106 in seen["decontamination"]) == (want[9106] > 2048)


def test_stages_keep_nulls_that_are_no_reason_to_drop(spark):
    docs = spark.createDataFrame([(None, "the of and to in", "en", None, None), (1, "the of and to in", None, "s", 1), (2, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.deduplicate(docs).count() == 3
