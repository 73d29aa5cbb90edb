import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmesh.llm import vector_codes
from lexmesh.llm.vector_codes import Bounds, code_vectors, codes, moved, searched

SCHEMA = "vec_id long, embedding array<float>, label string, code string, error string, salt int, of_label int, x int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes by working out every distance with Python's integers; rows of (vec_id, vector, label)."""
    rows = [(i, v, g) for i, v, g in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], g) for i, v, g in rows]
    d = len(rows[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in rows]
    books = [[cut[j][p] for j in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[1] for c in cut]
            for j in range(len(books[p])):
                members = [c[p] for c, o in zip(cut, own, strict=True) if o == j]
                if members:
                    books[p][j] = [sum(m[i] for m in members) // len(members) for i in range(d)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(x for x, _ in f) for f in found]
    by_label = {}
    for (_, _, g), e in zip(rows, errors, strict=True):
        by_label[g] = by_label.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by_label[g], digest) for (i, _, g), f, e in zip(rows, found, errors, strict=True)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, "c", "e", 1, 2, 3) for i, v, g in rows], SCHEMA).repartition(3)


def clustered(n, width=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, width))
    return [(int(i), [float(np.float32(x)) for x in centres[rng.integers(12)] + rng.normal(0, 0.1, width)], rng.choice(["a", "b"]) if i % 5 else None) for i in rng.permutation(n)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = clustered(200)
    vector = rows[0][1]
    rows += [(900, None, "a"), (901, [], "a"), (902, [float("nan"), *vector[1:]], "a"), (903, [float("inf"), *vector[1:]], "b"), (904, [None, *vector[1:]], "b")]
    rows += [(None, vector, "a"), (None, rows[1][1], "n"), rows[2], rows[2], *[(1000 + i, rows[3][1], "hot") for i in range(150)]]
    got = sorted((tuple(r) for r in code_vectors(table(spark, rows)).collect()), key=repr)
    assert got == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 17])
def test_few_rows_and_ties(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(8)], "a") for i in range(n)]
    assert sorted((tuple(r) for r in code_vectors(table(spark, rows)).collect()), key=repr) == plain(rows)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = clustered(60)
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)
    assert sorted((tuple(r) for r in code_vectors(table(spark, rows)).collect()), key=repr) == plain(rows)


def test_bounds_spare_distances_and_lists_adapt(spark):
    rows = clustered(600)
    _, books = codes(table(spark, rows))
    first, last = books.needs[0], books.needs[-1]
    assert (first[:, -1] == 600).all() and last[:, 0].sum() > 0.9 * last.sum()
    assert books.lists != [4] * 8 and all(2 <= b <= 8 for b in books.lists)


def test_lengths_that_do_not_fit(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes(table(spark, [(1, [1.0] * 9, "a")]))
    rows = [(1, [1.0] * 8, "a"), (2, [2.0] * 16, "a"), (3, [3.0] * 8, "a")]
    got = code_vectors(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 3}
    assert code_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    big = code_vectors(table(spark, [(1, [3e38] * 8, "a"), (2, [-3e38] * 8, "a")])).collect()
    assert sorted((r.code, r.error) for r in big) == [("00" * 8, 0), ("01" * 8, 0)]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_bounds_never_lose_the_nearest(data):
    """Entries that jump about, lists that grow and shrink: always the exact nearest entry, ties by index."""
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    k, d, spread = data.draw(st.integers(1, 16)), data.draw(st.integers(1, 4)), data.draw(st.sampled_from([2, 50, 10**6]))
    x = rng.integers(-spread, spread + 1, (40, d))
    entries = rng.integers(-spread, spread + 1, (k, d))
    b = data.draw(st.integers(1, 8))
    state = searched(x, entries, b)
    for _ in range(5):
        b = data.draw(st.integers(1, 8))
        state = Bounds.unpack(state.resized(b).pack(), b)
        step = data.draw(st.sampled_from([0, 1, spread]))
        new = entries + rng.integers(-step, step + 1, (k, d))
        drift = np.sqrt(((new - entries).astype(float) ** 2).sum(1)) * (1 + 1e-6)
        state, need = moved(x, state, new, drift)
        entries = new
        want = ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (state.entry == want).all()
        assert need.max() <= b + 1
