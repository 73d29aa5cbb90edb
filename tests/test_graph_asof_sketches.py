import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmesh.operators import as_of_join, block_graph, estimates, merged, value_sketches


def test_block_graph_follows_its_rule(spark):
    rng = random.Random(4)
    left = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(80)] + [None, "aa", "aa"]
    right = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(90)] + [None]
    most, keep = 6, 2

    def keys(word):
        return {f"b{word[:1]}", f"e{word[-2:]}"}

    a, b = ([(w, c) for w in {*side} - {None} for c in keys(w)] for side in (left, right))
    weights = defaultdict(list)
    for part in (len, lambda w: w, None):
        n = Counter(c for _, c in b)
        for x, c in a:
            for y, d in b:
                if c == d and (n[c] <= most or part is None):
                    weights[x, y].append(10**6 // n[c])
        if part:
            a, b = ([(w, (c, part(w))) for w, c in side if n[c] > most] for side in (a, b))
    edges = defaultdict(list)
    for (x, y), own in weights.items():
        edges[x].append((sum(own), len(own), y))
    want = {(x, y, n, w) for x, own in edges.items() for w, n, y in own if sum(v > w for v, _, _ in own) < keep}
    make = lambda side, name: spark.createDataFrame([(w,) for w in side], f"{name} string")
    codes = lambda w: F.array(F.concat(F.lit("b"), F.substring(w, 1, 1)), F.concat(F.lit("e"), F.right(w, F.lit(2))), F.concat(F.lit("b"), F.substring(w, 1, 1)))
    got = block_graph(make(left, "l"), make(right, "r"), "l", "r", codes, [F.char_length], most, keep)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert block_graph(make([None], "l"), make(right, "r"), "l", "r", codes).collect() == []
    assert block_graph(make(left, "l"), make([None], "r"), "l", "r", codes).collect() == []


def test_block_graph_is_linear_under_a_common_code(spark):
    words = spark.range(3000).select(F.concat(F.lit("same"), F.col("id")).alias("w"))
    got = block_graph(words, words.withColumnRenamed("w", "v"), "w", "v", lambda w: F.array(F.lit("x")), [lambda w: F.right(w, F.lit(2))], 50, 3)
    assert got.groupBy("left_value").count().agg(F.max("count")).first()[0] <= 50


@pytest.mark.parametrize("width", [3, 1000, 10**7])
def test_as_of_join(spark, width):
    rng, zero = random.Random(3), datetime(2024, 1, 1)
    time = lambda: None if rng.random() < 0.05 else zero + timedelta(seconds=rng.randrange(300))
    key = lambda: rng.choice([None, "hot", "hot", "hot", "a", "b"])
    left = [(i, key(), time()) for i in range(150)] + [(7, "hot", zero), (7, "hot", zero)]
    right = [(rng.choice([i, None]), key(), time(), rng.choice([None, "v", "w"])) for i in range(120)]
    a, b = spark.createDataFrame(left, "i long, k string, t timestamp"), spark.createDataFrame(right, "j long, rk string, rt timestamp, v string")
    order = lambda r: tuple((x is not None, x) for x in r)
    want = []
    for i, k, t in left:
        fits = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and r[2] <= t]
        best = max(fits, key=lambda r: (r[2], order(r)), default=(None,) * 4)
        want.append((i, k, t, *best))
    got = [tuple(r) for r in as_of_join(a, b, "k", "rk", "t", "rt", width).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    none = as_of_join(a, b.limit(0), "k", "rk", "t", "rt").collect()
    assert len(none) == len(left) and all(r.j is None and r.rt is None for r in none)
    assert as_of_join(a.limit(0), b, "k", "rk", "t", "rt").collect() == []
    assert "NestedLoop" not in as_of_join(a, b, "k", "rk", "t", "rt")._jdf.queryExecution().executedPlan().toString()


def test_sketches_are_merged_without_the_values(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"w{int(rng.paretovariate(0.7)) % 40_000}", rng.choice(["a1", "a2", "b1"])) for _ in range(60_000)] + [(None, "a1"), (None, "c")]
    df = spark.createDataFrame(rows, "w string, code string")
    value_sketches(df, "w", "code").write.parquet(str(tmp_path / "sketches"))
    wide = merged(spark.read.parquet(str(tmp_path / "sketches")), F.substring("code", 1, 1).alias("initial"))
    exact = defaultdict(Counter)
    for w, code in rows:
        if w is not None:
            exact[code[0]][w] += 1
    got = {r.initial: r for r in estimates(wide, 5).collect()}
    assert set(got) == set(exact)
    for initial, counts in exact.items():
        r = got[initial]
        assert r.n == sum(counts.values())
        assert abs(r.n_distinct - len(counts)) <= 4 * 1.04 / 64 * len(counts)  # four standard errors
        for x in r.top:
            assert counts[x["item"]] <= x["count"] <= counts[x["item"]] * 1.02 + 5
        assert {x["item"] for x in r.top[:3]} == {w for w, _ in counts.most_common(3)}
    assert estimates(value_sketches(df.limit(0), "w", "code")).collect() == []
