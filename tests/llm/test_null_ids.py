"""Null ids, and a text longer than any slice, through every operator."""

import json

import public_tokenizers
import pytest

from lexmesh.llm import fingerprints, maxent_lm, mixing, ngram_join, packing, quality_classifier, quality_rules, token_counts, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 5003} é{i % 7}" for i in range(220_000))
ROWS = [(None, "a b c d e f g", "s"), (None, "a b c d e f g", "s"), (1, "A b c d e f g", None), (2, LONG, "s"), (None, None, None), (3, LONG + " x", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    assert len(LONG.encode()) > 2_500_000
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in ROWS], "doc_id long, text string, lang string, source string").repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 0, 1), (1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


def test_scores_of_null_ids(odd, labels):
    for found in (quality_classifier.classify(odd, labels), quality_rules.judge(odd, labels), toxicity.score_toxicity(odd, labels), maxent_lm.score_texts(odd)):
        rows = found.collect()
        assert len(rows) == len(ROWS) and sum(r.doc_id is None for r in rows) == 3
    words = {r.doc_id: r.n_words for r in quality_rules.judge(odd, labels).collect()}
    assert words[2] == 440_000 and words[3] == 440_001


def test_joins_of_null_ids(odd):
    rows = ngram_join.classes(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 1), (0, 1), (1, 1), (2, 2), (3, 2)]
    prints = [(r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(odd).collect()]
    assert len({p for i, p in prints}) == 4 and len(fingerprints.fingerprint_edits(odd).collect()) == len(ROWS)
    assert mixing.mix(odd).count() == len(ROWS)


def test_tokens_of_null_ids(odd):
    counts = token_counts.count_tokens(odd, PATH).groupBy("doc_id").sum("tokens").collect()
    pieces = packing.pack(odd, PATH).groupBy("doc_id").sum("length").collect()
    by_id = {r[0]: r[1] for r in counts}
    rows_of = {None: 3, 1: 1, 2: 1, 3: 1}
    assert {r[0]: r[1] for r in pieces} == {i: int(n) + rows_of[i] for i, n in by_id.items()}


def test_other_vocabularies_are_refused(tmp_path):
    """A normaliser that the fast encoder does not know would give other ids."""
    file = json.loads(open(PATH, encoding="utf-8").read())
    (tmp_path / "lower.json").write_text(json.dumps(file | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    with pytest.raises(ValueError):
        packing.encoder(str(tmp_path / "lower.json"))
    assert packing.encoder(PATH).encode(["a b"])[0].size == 2


def test_separators_are_one_character(odd):
    for separator in ("", "\n\n"):
        with pytest.raises(ValueError):
            token_counts.count_tokens(odd, PATH, separator=separator)
