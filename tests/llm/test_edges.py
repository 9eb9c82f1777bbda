"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from palimpsest.llm import bpe, line_dedup, media, mixing, near_dup, pii, quality_fm, quality_rules, secret_scan, toxicity
from palimpsest.llm.queries import vocabulary_path

ROWS = {
    "quality": (lambda d, n: quality_rules.quality_rules(d), 10),
    "bpe": (lambda d, n: bpe.round_trip(d, vocabulary_path()), 10),
    "toxicity": (toxicity.toxicity, 10),
    "secrets": (lambda d, n: secret_scan.secret_scan(d), 0),
    "fm": (quality_fm.quality_classifier, 10),
    "pii": (lambda d, n: pii.personal_data(d), 10),
    "media": (lambda d, n: media.text_media(d), 10),
    "near": (lambda d, n: near_dup.near_duplicates(d), 10),
    "lines": (lambda d, n: line_dedup.line_dedup(d), 10),
}


@pytest.mark.parametrize("name", ROWS)
def test_odd_rows(name, odd, labels):
    run, want = ROWS[name]
    out = run(odd, labels).collect()
    assert len(out) == want
    same = [r for r in out if r["doc_id"] == 6]
    assert len(set(same)) <= 1


@pytest.mark.parametrize("name", ROWS)
def test_empty_table(name, none, labels):
    assert ROWS[name][0](none, labels.limit(0)).count() == 0


def test_defined_results(odd, labels):
    near = {r["doc_id"]: r for r in near_dup.near_duplicates(odd).collect() if r["doc_id"] is not None}
    assert near[6]["component_id"] == 1 and not near[6]["kept"] and near[1]["kept"]
    assert all(near[k]["n_shingles"] == 0 and near[k]["kept"] and near[k]["component_id"] == k for k in (2, 3, 4))
    scores = {r["doc_id"]: r for r in toxicity.toxicity(odd, labels).collect()}
    assert all(scores[k]["score"] == 0 for k in (2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in quality_fm.quality_classifier(odd, labels).collect())
    tokens = {r["doc_id"]: r for r in bpe.round_trip(odd, vocabulary_path()).collect()}
    assert tokens[2]["n_tokens"] == tokens[3]["n_tokens"] == 0 and tokens[5]["n_tokens"] > 60_000
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert rules[2]["base_failed"] and not rules[2]["kept"]
    boxes = {r["doc_id"]: r for r in media.text_media(odd).collect()}
    assert boxes[2]["n_bytes"] == 0 and boxes[2]["payload_bytes"] == 576


def test_mixing_counts_repeated_rows(odd, none):
    out = mixing.mix_sources(odd, mixing.Mix(percent=200, max_epochs=2)).collect()
    assert len([r for r in out if r["doc_id"] == 6]) == 4 and {r["epoch"] for r in out} == {1, 2}
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(odd, mixing.Mix(tokens=0)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_the_columns(stage, spark, odd, none):
    name, run = corpus_pipeline.STAGES[stage]
    out, empty = run(spark, odd, ""), run(spark, none, "")
    assert empty.count() == 0
    if stage < 4:
        assert out.columns == odd.columns == empty.columns
        rows = {tuple(r)[5:] for r in out.collect()}
        assert rows <= {("extra", 0.5, "extra", 7, "extra", 1, "extra", 0, 6, "extra", "extra")}
    else:
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() == 10
