import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmesh.llm import ngram_join, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    least = defaultdict(lambda: 1 << 60)
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least[find(x)], i)
    return Counter((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def test_join(docs, small, empty):
    rows = ngram_join.classes(docs).collect()
    assert Counter(map(tuple, rows)) == components([(i, t) for i, t, _, _ in small])
    assert ngram_join.classes(empty).count() == 0
    left = ngram_join.deduplicate(docs)
    assert left.columns == docs.columns
    want = {i for (i, n, c) in components([(i, t) for i, t, _, _ in small]) if i == c}
    assert sorted(r.doc_id for r in left.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_join_of_families(spark, seed):
    """Families of edited copies around the threshold, shared passages, and exact copies."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(rng.randrange(20, 160))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                own[5:5] = passage[: rng.randrange(10, 40)]
            rows.append((len(rows) * 3 % 1009, " ".join(own[: rng.randrange(len(own) * 8 // 10, len(own) + 1)])))
    rows += [(2000 + i, rows[7][1]) for i in range(40)] + [(3000 + i, " ".join(passage)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter(map(tuple, ngram_join.classes(df).collect())) == components(rows)


def test_widespread_shingles_are_asked_for_once(spark):
    """More sets of a chunk than MANY share a shingle: the lists go another way, with the same result."""
    rows = [(i, "a b c d e " + " ".join(f"w{i}_{j}" for j in range(i % 7))) for i in range(150)] + [(1000 + i, "common line of just six words " + f"z{i // 2}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(map(tuple, ngram_join.classes(df).collect())) == components(rows)


def test_one_family_of_near_copies(spark):
    """Thousands of copies of one text, each with its own edits; some of them link with none or only with one another."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(3000):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6, 7])):
            own[at] = rng.choice(["x", "y", f"e{i}_{at}", f"e{i}_{at}"])
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter(map(tuple, ngram_join.classes(df).collect())) == components_by_candidates(rows)


def components_by_candidates(rows):
    """As ``components``, by a count of the shingles that each set shares with those before it."""
    sets, lists = [(i, shingle_set(t)) for i, t in rows], defaultdict(list)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, (_, own) in enumerate(sets):
        shared = Counter()
        for s in own:
            shared.update(lists[s])
            lists[s].append(x)
        for y, both in shared.items():
            if 100 * both >= 75 * (len(own) + len(sets[y][1]) - both):
                parent[find(x)] = find(y)
    least = defaultdict(lambda: 1 << 60)
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least[find(x)], i)
    return Counter((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def test_slices_have_a_bound_of_rows(spark):
    """More short rows in an Arrow batch than 16-bit numbers count."""
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        df = spark.range(66_005).selectExpr("id AS doc_id", "concat('t', id % 33000) AS text").coalesce(1)
        rows = ngram_join.classes(df).selectExpr("max(doc_id)", "sum(n_shingles)", "count_if(component_id = doc_id % 33000)").first()
        assert tuple(rows) == (66_004, 66_005, 66_005)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)


def test_a_long_compilation_leads_no_list_astray(spark):
    """The set with the fewest shingles of its own leads all lists of two near copies, and links with neither."""
    base = [f"b{i}" for i in range(60)]
    near = [*base[:30], "other", *base[31:]]
    rows = [(1, " ".join([*base, "u1"])), (2, " ".join([*near, "u2"])), (3, " ".join([*base, *near, *(f"c{i}" for i in range(300))])), (4, " ".join(f"c{i}" for i in range(300)))]
    assert Counter(map(tuple, ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == components(rows)


@pytest.fixture(scope="module")
def ids(small):
    own = Tokenizer.from_file(PATH)
    return [(i, s, np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t, _, s in small]


@pytest.mark.parametrize(("window", "targets"), [(64, None), (256, {"src0": 1, "src1": 5, "src2": 1, "src10": 1, None: 0.1})])
def test_packing(docs, ids, window, targets, empty):
    rows = packing.pack(docs, PATH, targets, window).collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert r.length > 0
        by_doc[r.doc_id].append(r)
    for i in {i for i, _, _ in ids}:
        same = [x for j, _, x in ids if j == i]
        starts = Counter(r.start for r in by_doc[i])
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        if len(same) == 1:
            assert max(starts.values()) == 1
            assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == sum(map(len, same))
        assert all(r.ids_crc32 == zlib.crc32(same[0][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(same[0]) for r in pieces)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    total = sum(len(x) for _, _, x in ids)
    assert sorted(windows) == list(range(-(-total // window)))
    for w, own in windows.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or w == max(windows)
    if targets is None:
        share = Counter()
        for _, s, x in ids:
            share[s] += len(x)
        for w, own in windows.items():
            if w < max(windows) - 2:
                held = Counter()
                for r in own:
                    held[r.source] += r.length
                assert all(abs(held[s] - window * share[s] / total) <= len(share) + 2 for s in share)
    assert packing.pack(empty, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=5), st.lists(st.integers(1, 50), min_size=5, max_size=5), st.sampled_from([8, 16, 50]))
def test_schedule_is_deficit_round_robin(totals, weights, window):
    """The closed form gives what serving the queues round by round gives."""
    weights = weights[: len(totals)]
    schedule = packing.Schedule(totals, weights, window)
    credit, served, stream = [0] * len(totals), [0] * len(totals), []
    while len(stream) < sum(totals):
        for q in range(len(totals)):
            credit[q] += int(schedule.quanta[q])
            while credit[q] >= 1 << packing.SHIFT and served[q] < totals[q]:
                credit[q] -= 1 << packing.SHIFT
                stream.append((q, served[q]))
                served[q] += 1
    for q, n in enumerate(totals):
        places = schedule.place(q, np.arange(n))
        assert [stream[p] for p in places.tolist()] == [(q, t) for t in range(n)]
        cuts = [*schedule.cuts(q, 0, n).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            assert (np.diff(places[a:b]) == 1).all() and places[a] // window == places[b - 1] // window


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ''sStTrReEvVlLdD  \n\t\r!?.,01é²ªº½ÀßñŁəЖ中😀\x85\x1c"), max_size=25), max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    own = packing.encoder(PATH)
    ids, bounds = own.encode([*texts, "x <|endoftext|> y"])
    want = [e.ids for e in own.tokenizer.encode_batch([*texts, "x <|endoftext|> y"], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "REMEMBERED", 5)
    own = packing.Encoder(PATH)
    for text in ("one two three four five six", "seven eight one", "two nine ten eleven twelve thirteen"):
        ids, _ = own.encode([text])
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(docs, small, rule, empty):
    own = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, _, _ in small:
        text = text or ""
        parts = [p for p in re.split(r"(?<=\n)", text) if p] or [""]
        edges = np.cumsum([0, *map(len, parts)])
        tokens = np.zeros(len(parts))
        for a, b in own.encode(text, add_special_tokens=False).offsets:
            held = [max(0, min(b, y) - max(a, x)) for x, y in zip(edges, edges[1:], strict=False)]
            if rule == "share":
                tokens += np.array(held) / (b - a)
            else:
                tokens[np.argmax(held) if rule == "most" else next(k for k, h in enumerate(held) if h)] += 1
        for k, p in enumerate(parts):
            want[i, k, int(edges[k]), len(p), round(float(tokens[k]), 6)] += 1
    rows = token_counts.count_tokens(docs, PATH, rule).collect()
    assert Counter((r.doc_id, r.section, r.start, r.length, round(r.tokens, 6)) for r in rows) == want
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_field_tokens(spark):
    df = spark.createDataFrame([(1, "Hello", None, "world"), (2, None, None, None)], "doc_id long, a string, b string, text string")
    got = {(r.doc_id, r.field): r.tokens for r in token_counts.count_field_tokens(df, ["a", "b", "text"], PATH).collect()}
    own = Tokenizer.from_file(PATH)
    assert sum(got[1, f] for f in ("a", "b", "text")) == len(own.encode("Hello\n\nworld").ids)
    assert sum(got[2, f] for f in ("a", "b", "text")) == len(own.encode("\n\n").ids)
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, PATH, "other")
