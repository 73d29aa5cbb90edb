import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmesh.llm import chunks as ch
from lexmesh.llm import maxent_lm, quality_classifier, quality_rules, toxicity
from lexmesh.llm.textbytes import Texts

def levenshtein_of(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(left + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def slow_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab \n\té#|🎉"), max_size=80)), max_size=6))
def test_counts(texts):
    found = quality_rules.counts(Texts(pa.array(texts, pa.string())))
    assert [tuple(int(found[c][i]) for c in quality_rules.COUNTS[:5]) for i in range(len(texts))] == [slow_counts(t) for t in texts]


@pytest.fixture(scope="module")
def corpus():
    """Clean and junk prose, some of it toxic, in two sources; labels for half of it."""
    rng = random.Random(3)
    # Clean words have no letter pair of the toxic ones beside them.
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "tu", "se", "pa"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    slurs = ["grubbler", "wexnord", "zanfrit", "quogmire"]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(25, 120))]
        good, toxic = rng.random() > 0.2, rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(slurs))
        if not good:
            kind = rng.randrange(2)
            words = [w.upper() + "!!" for w in words] if kind else [w + rng.choice(["***", "%%%", " |"]) for w in words]
        docs.append((i, " ".join(words), "en", "bad" if not good and rng.random() < 0.8 else "fine"))
        if i % 2 == 0:
            labels.append((i, int(good), int(toxic)))
    return docs, labels, slurs


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs, labels, _ = corpus
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4), spark.createDataFrame([*labels, (None, 0, 1), (2, None, None)], LABELS)


def truth(corpus):
    return {d[0]: ("!!" in d[1] or "***" in d[1] or "|" in d[1] or "%%%" in d[1]) for d in corpus[0]}


def test_rules_learn(frames, corpus):
    docs, labels = frames
    rows, junk = quality_rules.judge(docs, labels).collect(), truth(corpus)
    assert sum(r.kept == junk[r.doc_id] for r in rows) <= 0.02 * len(rows)
    texts = {d[0]: d[1] for d in corpus[0]}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(texts[r.doc_id]) for r in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_rules_are_conjunctions_in_order():
    x = {"a": np.r_[np.zeros(100), np.ones(100)], "b": np.tile([0.0, 1.0], 100)}
    bad = (x["a"] == 1) & (x["b"] == 1)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(200, bool)
    for r in rules:
        hit |= r.covers(x)
    assert (hit == bad).all() and len(rules) == 1 and len(rules[0].tests) == 2
    assert quality_rules.learn(x, np.zeros(200, bool)) == []


def test_rules_on_odd_rows(docs, small, empty, spark):
    labels = spark.createDataFrame([], LABELS)
    rows = quality_rules.judge(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((i, *slow_counts(t)) for i, t, _, _ in small)
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.judge(empty, labels).count() == 0 and quality_rules.keep(empty, labels).columns == docs.columns
    assert Counter(quality_rules.keep(docs, labels).select("doc_id").collect()) == Counter((r.doc_id,) for r in rows if r.kept)


def test_co_training(frames, corpus):
    docs, labels = frames
    rows, junk = quality_classifier.classify(docs, labels, max_labelled=300).collect(), truth(corpus)
    held = [r for r in rows if r.doc_id % 2]
    assert len(rows) == 1500 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.kept == junk[r.doc_id] for r in held) <= 0.03 * len(held)
    # The metadata view alone tells less, but more than chance.
    assert sum((r.meta_score >= 0.5) != junk[r.doc_id] for r in held) >= 0.8 * len(held)


def test_every_unlabelled_row_takes_part(spark):
    """Sums over the pool hold each confident row outside the labelled ones, once."""
    rows = [(i, ("a b c " if i % 3 else "** || %% ") * (1 + i % 7), "s") for i in range(9000)] + [(None, "a b", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], LABELS)
    features = quality_classifier.featured(docs)
    pdf = features.join(labels, "doc_id").toPandas()
    text, meta = (np.stack([np.frombuffer(x, np.float16) for x in pdf[c]]).astype(np.float32) for c in ("text_view", "meta_view"))
    models = [quality_classifier.fit_view(x, pdf["quality"].to_numpy(float)) for x in (text, meta)]
    sums = quality_classifier.pool_sums(features, models, list(range(300)), 0.95)
    # The text view tells all rows apart and teaches the metadata view.
    assert [round(products[-1, -1]) for _, products in sums[1]] == [2900, 5800]
    model = quality_classifier.fit(features, labels)
    assert model is not None and len(model.text.w) == text.shape[1]


def test_whole_pool_on_unseen_rows(frames, corpus):
    docs, labels = frames
    rows, junk = quality_classifier.classify(docs, labels, max_labelled=300).collect(), truth(corpus)
    held = [r for r in rows if r.doc_id % 2]
    assert len(rows) == 1500 and sum(r.kept == junk[r.doc_id] for r in held) <= 0.03 * len(held)


def test_pseudo_labels_help(spark):
    """With few labels, a view that has no signal in them learns from the other's confident ones."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    text = np.stack([y * 2 - 1 + rng.normal(0, 0.4, 600), rng.normal(size=600)], 1).astype(np.float32)
    meta = np.stack([y * 2 - 1 + rng.normal(0, 0.8, 600), *(rng.normal(size=600) for _ in range(20))], 1).astype(np.float32)
    label = np.where(np.arange(600) < 16, y, -1)
    text, meta = text.astype(np.float16), meta.astype(np.float16)
    features = spark.createDataFrame([(i, a.tobytes(), b.tobytes()) for i, (a, b) in enumerate(zip(text, meta, strict=True))], "doc_id long, text_view binary, meta_view binary")
    text, meta = text.astype(np.float32), meta.astype(np.float32)
    known = label >= 0
    with_rounds, without = (quality_classifier.co_train_all(features, list(range(16)), text[known], meta[known], label[known], rounds=n) for n in (4, 0))
    assert ((with_rounds.meta.raw(meta) > 0) == y).mean() > ((without.meta.raw(meta) > 0) == y).mean()
    assert quality_classifier.co_train_all(features, [], text[:0], meta[:0], label[:0]) is None


def test_both_views_weigh_in(spark):
    """Views that err apart are both taken, though one alone is far better."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 4000)
    views = tuple(((y * 2 - 1)[:, None] + rng.normal(0, s, (4000, 1))).astype(np.float32) for s in (0.5, 1.2))
    own, held = np.arange(2000), np.arange(2000, 4000)
    models = [quality_classifier.fit_view(x[own], y[own].astype(float)) for x in views]
    found = quality_classifier.combined(models, views, y, held)
    assert (found.w > 0.3).all()
    a, b, both = (((p >= 0.5) != y).mean() for p in found.score(*views))
    assert both < min(a, b)


def test_classifier_on_odd_rows(docs, small, empty, spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    assert quality_classifier.classify(docs, labels).count() == len(small)
    assert quality_classifier.classify(empty, labels).count() == 0
    kept = quality_classifier.keep(docs.drop("lang", "source"), labels)
    assert kept.columns == docs.drop("lang", "source").columns and kept.count() <= len(small)


def crc(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


def test_toxicity(frames, corpus, spark):
    docs, labels = frames
    _, _, slurs = corpus
    more = [(5000, "ka lo mi grubler se pa tu"), (5001, "ka lo wexn0rd mi"), (5002, 'said "grubbler" ka lo'), (5003, "ka lo mi tu"), (5004, None), (5005, ""), (5006, "you zanfrit"), (5006, "you zanfrit")]
    rows = toxicity.score_toxicity(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), labels).collect()
    score = {r.doc_id: r.score for r in rows}
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    own = {d[0]: any(s in d[1].lower() for s in slurs) for d in corpus[0]}
    assert sum((score[i] >= 0.7) != own[i] for i in own) <= 0.01 * len(own)
    assert score[5000] >= 0.7 and score[5001] >= 0.7 and score[5006] >= 0.7
    assert score[5003] == score[5004] == score[5005] < 0.3 and score[5002] < score[5006]
    assert len(rows) == 1508


def test_misspellings_of_a_term_amid_clean_words(spark):
    """Clean texts that hold near forms of a term take those forms alone, however many there are."""
    rng = random.Random(4)
    words = ["".join(rng.choice(["ka", "lo", "mi", "tu"]) for _ in range(3)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(20)]
        text.insert(rng.randrange(20), "grubbel" if i % 4 == 0 else rng.choice(["trubbel", "grabbel", "grubbes", "grubbet"]))
        rows.append((i, " ".join(text)))
        labels.append((i, None, int(i % 4 == 0)))
    more = [(1000, "ka grubbwl mi"), (1001, "ka grabbel mi"), (1002, "ka mi")]
    got = toxicity.score_toxicity(spark.createDataFrame(rows + more, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))
    score = {r.doc_id: (r.score, r.n_misspelled) for r in got.where("doc_id >= 1000").collect()}
    assert score[1000][1] == 1 and score[1000][0] > score[1001][0] == score[1002][0] and score[1001][1] == 0


@pytest.mark.parametrize("toxic_share", [0.2, 0.5, 0.8])
def test_terms_in_few_phrases_are_found(spark, toxic_share):
    """A slur in 200 toxic texts, always in one of six phrases; the words of a passage that 200 toxic texts copy are none."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    phrases = [f"{rng.choice(words)} grobnak {rng.choice(words)}" for _ in range(6)]
    passage = " ".join("".join(rng.choice("xyzvw") for _ in range(7)) for _ in range(30))
    n_toxic = 400
    rows = []
    for i in range(round(n_toxic / toxic_share)):
        own = [rng.choice(words) for _ in range(40)]
        if i < n_toxic:
            own.insert(rng.randrange(40), rng.choice(phrases) if i % 2 else passage)
        rows.append((i, " ".join(own), 1, int(i < n_toxic)))
    model = toxicity.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, t) for i, _, q, t in rows], LABELS))
    assert "grobnak" in model.terms and not set(passage.split()[1:-1]) & set(model.terms)


def test_toxicity_on_odd_rows(docs, small, empty, spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score_toxicity(docs, none).count() == len(small)
    assert toxicity.score_toxicity(empty, none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abcde", min_size=3, max_size=11), min_size=1, max_size=8), st.lists(st.text("abcde", max_size=12), min_size=1, max_size=20))
def test_automata_find_the_nearest_term(terms, words):
    def nearest(word):
        found = [(d, t) for t in terms if (d := levenshtein_of(word, t)) <= toxicity.allowed(t)]
        return min(found)[::-1] if found else None

    trie, matcher = toxicity.Trie(terms), toxicity.Matcher(terms)
    assert [trie.nearest(w) for w in words] == [nearest(w) for w in words]
    # The quick test by pieces loses no match.
    _, at, what, _ = matcher.hits(Texts(pa.array([" ".join(words)])))
    full = [w for w in words if w]
    assert dict(zip(at.tolist(), what, strict=True)) == {i: (w, *nearest(w)) for i, w in enumerate(full) if nearest(w)}


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_two_edits_from_nine_letters_on(data):
    """Terms of 9 to 16 letters with two edits, transpositions and four-byte letters among them, are found through the pieces."""
    terms = data.draw(st.sets(st.text("abcdeé", min_size=9, max_size=16), min_size=1, max_size=6))
    words = []
    for term in sorted(terms):
        word = term
        for _ in range(2):
            at, char = data.draw(st.integers(0, len(word) - 1)), data.draw(st.sampled_from("abzé🎉"))
            word = data.draw(st.sampled_from([word[:at] + char + word[at + 1 :], word[:at] + char + word[at:], word[:at] + word[at + 1 :]]))
        at = data.draw(st.integers(0, len(term) - 2))
        words += [word, term[:at] + term[at + 1] + term[at] + term[at + 2 :]]
    _, at, what, _ = toxicity.Matcher(terms).hits(Texts(pa.array([" ".join(words)])))
    found = dict(zip(at.tolist(), what, strict=True))
    for i, word in enumerate(words):
        d, term = min((levenshtein_of(word, t), t) for t in terms)
        assert d <= 2 and found[i] == (word, term, d)


def test_context_weights():
    plain = toxicity.context_weight(["a"], "loser", ["b"])
    assert toxicity.context_weight(["a"], '"loser"', ["b"]) < plain < toxicity.context_weight(["you"], "loser", ["b"])
    assert toxicity.context_weight(["he", "said", '"what', "a"], "loser", ['man"']) < plain


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("aäßб", min_size=5, max_size=12), min_size=1, max_size=6), st.lists(st.text("aAäÄßбБ😀", max_size=13), min_size=1, max_size=12), st.sampled_from(["{}", "“{}”", "«{}»,", "¿{}?", "'{}'…", "– {} –"]))
def test_no_match_is_lost_to_case_or_marks(terms, words, frame):
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(frame.format(w) for w in words)])], ["text"])
    lower = next(toxicity.lowered(iter([batch]))).column(0)
    _, _, what, _ = toxicity.Matcher(terms).hits(Texts(lower))
    want = []
    for word in pa.compute.utf8_lower(pa.array(words)).to_pylist():
        near = [(d, t) for t in terms if (d := levenshtein_of(word, t)) <= toxicity.allowed(t)]
        want += [(word, *min(near)[::-1])] if word and near else []
    assert what == want


def test_context_is_learned(spark):
    """A word that stands beside the term in clean texts takes its weight, as does quotation; a list has neither."""
    rng = random.Random(6)
    words = ["".join(rng.choice(["ka", "lo", "mi", "tu"]) for _ in range(3)) for _ in range(100)]
    rows, labels = [], []
    for i in range(1200):
        text, clean = [rng.choice(words) for _ in range(30)], i % 2
        if not clean:
            text.insert(rng.randrange(30), "grubbler")
        elif i % 40 == 1:
            at = rng.randrange(30)
            text[at:at] = ["zitierend", "grubbler"]
        rows.append((i, " ".join(text)))
        labels.append((i, None, int(not clean)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(df, marks)
    assert model.terms == ["grubbler"] and model.words["zitierend"] < 0.6 < 0.9 < min(model.words.get(w, 1.0) for w in words)
    more = spark.createDataFrame([(1, "ka lomi grubbler tuka"), (2, "ka zitierend grubbler tuka"), (3, "ka “grubbler” tuka")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.scored(more, model).collect()}
    assert score[1] >= 0.7 > score[2] and score[3] < score[1]


def base_scores(rows):
    def tokens(text):
        return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]

    counts = Counter(w for i, t in rows if crc(i, 5) != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return Counter((i, crc(i, 5) == 1, len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)


def test_language_model(docs, small, empty):
    rows = maxent_lm.score_texts(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == base_scores([(i, t) for i, t, _, _ in small])
    assert maxent_lm.score_texts(empty).count() == 0


def test_language_model_beats_unigrams(spark):
    rng, rows = random.Random(5), []
    for i in range(1000):
        alphabet = ("aeiou", "xyzqw")[i % 2]
        rows.append((i, " ".join("".join(rng.choice(alphabet) for _ in range(3)) for _ in range(60))))
    got = maxent_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.95


def test_language_model_is_a_distribution():
    """The probabilities of all classes of a context add up to one, and those of all groups of a class."""
    rng = np.random.default_rng(2)
    classes = rng.integers(0, maxent_lm.CLASSES, maxent_lm.ENDINGS)
    base = np.log(rng.dirichlet(np.ones(maxent_lm.GROUPS), maxent_lm.CLASSES))
    tokens = maxent_lm.Tokens.of(pa.array(["a b c d", None, "the end"]))
    own = classes[tokens.ending]
    spans = maxent_lm.class_spans(rng.random(maxent_lm.CLASSES) + np.eye(maxent_lm.CLASSES)[3] * 40)
    assert (np.diff(spans) > 0).all() and (spans[:, -1] == maxent_lm.GROUP_SIZES).all()
    layers = (maxent_lm.SIZES, maxent_lm.CLASSES, tokens.features(classes), None), (maxent_lm.GROUP_SIZES, maxent_lm.GROUPS, tokens.group_features(own, spans), base[own])
    total = np.zeros(9)
    for sizes, kinds, features, start in layers:
        assert features.shape == (len(sizes), 9) and (features.max(1) < sizes).all()
        weights = rng.normal(size=(sum(sizes), kinds))
        z = maxent_lm.scores(weights, features, sizes, start)
        log_p = np.stack([maxent_lm.log_share(z, np.full(9, k)) for k in range(kinds)], 1)
        assert np.allclose(np.exp(log_p).sum(1), 1, atol=1e-5)
        table, want = np.zeros_like(weights), np.zeros_like(weights)
        maxent_lm.expected_counts(z, features, table, sizes)
        for token, rows in enumerate(features.T):
            for row, at in zip(rows, np.cumsum((0, *sizes)), strict=False):
                want[at + row] += np.exp(log_p[token])
        assert np.allclose(table, want, atol=1e-5)
        total += log_p[np.arange(9), own if start is None else tokens.groups()]
        if start is None:
            class_weights = weights
    model = maxent_lm.Model(classes, base, spans, class_weights, weights)
    assert np.allclose(maxent_lm.context_scores(model, tokens), total)


def test_language_model_knows_which_word_follows(spark):
    """Words of one ending, hence one class: only the layer of the groups can tell which of them follows."""
    rng, rows, names = random.Random(8), [], [f"{a}{b}ora" for a in "bcdfglmnprst" for b in "aeiou"]
    follows = dict(zip(names, rng.sample(names, len(names)), strict=True))
    for i in range(1000):
        text = [rng.choice(names)]
        while len(text) < 40:
            text.append(follows[text[-1]] if rng.random() < 0.9 else rng.choice(names))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    per_token = []
    for updates in (0, 1, 2, 3):
        got = maxent_lm.score_texts(docs, updates).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
        per_token.append(got[0])
    # Log loss on held-out texts falls with each update, and is well under that of the words alone.
    assert per_token == sorted(per_token) and per_token[2] > got[1] + 0.25


def test_training_cuts_no_held_out_text(monkeypatch):
    """Held-out texts are left out before their words are looked for."""
    seen, of = [], maxent_lm.Tokens.of
    monkeypatch.setattr(maxent_lm.Tokens, "of", lambda column: seen.extend(column.to_pylist()) or of(column))
    ids = list(range(40)) + [None]
    chunk = pa.RecordBatch.from_pylist([{"chunk": 1, "doc_ids": ids, "texts": [f"text {i}" for i in ids]}])
    tokens = list(maxent_lm.training_tokens([chunk]))
    want = [f"text {i}" for i in ids if crc(i, 5) != 1]
    assert seen == want and len(want) < 41 and [len(t.hash) for t in tokens] == [3 * len(want)]


def test_expected_counts_take_little_memory():
    """What is worked on beside the table is a few times the size of the scores, not a row of cells for each feature."""
    rng = np.random.default_rng(4)
    n, rows, table = 8_000, sum(maxent_lm.SIZES), np.zeros((maxent_lm.CLASSES, sum(maxent_lm.SIZES))).T
    features = np.stack([rng.integers(0, size, n) for size in maxent_lm.SIZES]).astype(np.uint16)
    z = rng.normal(size=(n, maxent_lm.CLASSES)).astype(np.float32)
    tracemalloc.start()
    maxent_lm.expected_counts(z, features, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.shape == (rows, maxent_lm.CLASSES) and np.isclose(table.sum(), n * len(maxent_lm.SIZES))
    assert peak < 5 * z.nbytes


def test_what_a_task_of_the_language_model_holds_is_bounded(spark, monkeypatch):
    # Written chunks: few rows together, where 100 were held before.
    words = F.expr("array_join(transform(sequence(1, 15000), x -> sha2(concat(id, '-', x), 256)), ' ')")
    chunks = ch.chunked(spark.range(0, 30, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text")))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in chunks.inputFiles()]
    assert sum(f.num_rows for f in files) >= 10 and max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 6
    # Ranges follow the texts, not the partitions alone.
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i % 7}") for i in range(200)], "doc_id long, text string").coalesce(1)
    chunks, found = ch.chunked(docs), {}
    for size in (ch.RANGE_BYTES, 40_000):
        monkeypatch.setattr(ch, "RANGE_BYTES", size)
        rows = ch.counted(chunks, maxent_lm.ask, 1).collect()
        found[size] = sum(r.chunk == -1 for r in rows), sorted((int(h), int(t)) for r in rows if r.chunk >= 0 for h, t in zip(ch.from_planes(r.hashes), np.frombuffer(r.totals, "<i8"), strict=True))
    (few, totals), (many, same) = found.values()
    assert few <= 4 and many > 20 and totals == same
    # A task answers one range before it reads the next.
    read = []

    def batches():
        for i in range(3):
            read.append(i)
            yield pa.RecordBatch.from_pylist([{"range": i, "chunk": 5, "hashes": ch.planes(np.array([i + 1], np.uint64)), "counts": np.array([2], "<u4").tobytes()}], pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    next(ch.answers(batches(), 1, 1))
    assert read == [0, 1]
