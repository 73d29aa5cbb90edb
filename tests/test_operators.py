import random

import pytest
from pyspark.sql import functions as F

from lexmesh.functions.distance import damerau
from lexmesh.functions.phonetic import metaphone
from lexmesh.operators import best_match, block_pairs, deletion_keys, fuzzy_anti, fuzzy_join, fuzzy_semi, metaphone_keys, soundex_keys
from lexmesh.operators.linkage import ranked_matches
from lexmesh.sources import read_table, write_table
from lexmesh.streaming import code_counts, match_stream
from plain import levenshtein_of, soundex_of


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(2)
    left, right = (["".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(60)] + [None, "dup", "dup"] for _ in range(2))
    return left, right, spark.createDataFrame([(i, v) for i, v in enumerate(left)], "lid int, l string"), spark.createDataFrame([(i, v) for i, v in enumerate(right)], "rid int, r string")


@pytest.mark.parametrize(("k", "metric"), [(0, "levenshtein"), (1, "levenshtein"), (2, "levenshtein"), (1, "damerau"), (2, "damerau")])
def test_fuzzy_joins_lose_nothing(sides, k, metric):
    left, right, l, r = sides
    distance = levenshtein_of if metric == "levenshtein" else lambda a, b: damerau([a], [b], [-1])[0]
    want = {(i, j, d) for i, a in enumerate(left) for j, b in enumerate(right) if a is not None and b is not None and (d := distance(a, b)) <= k}
    got = [tuple(x) for x in fuzzy_join(l, r, "l", "r", k, metric=metric).select("lid", "rid", "distance").collect()]
    assert len(got) == len(want) and set(got) == want
    near = {i for i, _, _ in want}
    assert {x.lid for x in fuzzy_semi(l, r, "l", "r", k, metric=metric).collect()} == near
    assert {x.lid for x in fuzzy_anti(l, r, "l", "r", k, metric=metric).collect()} == set(range(len(left))) - near


def test_best_and_ranked(spark):
    l = spark.createDataFrame([("Robert",), ("Rupert",), ("Smith",), (None,)], "l string")
    r = spark.createDataFrame([("Robart",), ("Rubert",), ("Smyth",), ("Zed",)], "r string")
    got = {x.left_value: (x.right_value, x.distance) for x in best_match(l, r, "l", "r", 3, soundex_keys).collect()}
    assert got == {"Robert": ("Robart", 1), "Rupert": ("Rubert", 1), "Smith": ("Smyth", 1)}
    ranks = ranked_matches(l, r, "l", "r", 3, soundex_keys, 2).where("left_value = 'Robert'").orderBy("rank").collect()
    assert [(x.right_value, x.rank) for x in ranks] == [("Robart", 1), ("Rubert", 2)]


def test_blocks(spark):
    l, r = spark.createDataFrame([("Smith",), ("Schmidt",)], "l string"), spark.createDataFrame([("Smyth",), ("Jones",)], "r string")
    assert {tuple(x) for x in block_pairs(l, r, "l", "r", metaphone_keys).collect()} == {("Smith", "Smyth"), ("Schmidt", "Smyth")}
    with pytest.raises(ValueError):
        deletion_keys(3)  # a join at 3 takes segments
    with pytest.raises(ValueError):
        fuzzy_join(l, r, "l", "r", 1, metric="other")


def test_joins_are_on_keys(spark, sides):
    _, _, l, r = sides
    plan = fuzzy_join(l, r, "l", "r", 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_tables(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "é a"), (2, None)], "i int, t string")
    write_table(df, str(tmp_path), "x", kind)
    back = read_table(spark, str(tmp_path), "x", kind, schema="i int, t string")
    assert sorted(map(tuple, back.collect()), key=repr) == [(1, "é a"), (2, None)]
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "x", "other")


def test_metaphone_queries_take_all_words(spark, tmp_path):
    from lexmesh import catalog

    for name, text in (("documents", "Façade, façade Straße mañana3 42 ok"), ("benchmark", "façade Müller"), ("conversations", "fassade MÜLLER muller")):
        write_table(spark.createDataFrame([(text,), (None,)], "text string"), str(tmp_path), name)
    found = {r.word: r.codes for r in catalog.queries()["double_metaphone"](spark, str(tmp_path)).collect()}
    assert set(found) == {"façade", "straße", "mañana3", "42", "ok"}
    assert all(codes == "/".join(metaphone(word)) for word, codes in found.items())
    pairs = {tuple(r) for r in catalog.queries()["block_metaphone_join"](spark, str(tmp_path)).collect()}
    want = {(a, b) for a in ("façade", "müller") for b in ("fassade", "müller", "muller") if set(metaphone(a)) & set(metaphone(b))}
    assert pairs == want and ("müller", "müller") in pairs


def test_deletion_keys_meet_all_near_pairs():
    """Every pair within a Damerau distance of k has a common form under k deletions."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(250)})

    def forms(word, k):
        last = out = {word}
        for _ in range(k):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            out = out | last
        return out

    pairs = [(a, b) for a in words for b in words if a < b]
    found = damerau([a for a, _ in pairs], [b for _, b in pairs], [2] * len(pairs))
    for k in (1, 2):
        keys = {w: forms(w, k) for w in words}
        assert all(keys[a] & keys[b] for (a, b), d in zip(pairs, found, strict=True) if d <= k)


def test_streams(spark, tmp_path):
    spark.createDataFrame([("Robert", 0), ("Rupert", 60), ("Ashcraft", 400)], "name string, s int").select("name", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, ts timestamp").parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("Robart",), ("Ashcroft",)], "known string")
    for df, mode, name in ((match_stream(stream, table, "name", "known", 2), "append", "matches"), (code_counts(stream, "name", "ts"), "complete", "counts")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert {(r.name, r.known, r.distance) for r in spark.table("matches").collect()} == {("Robert", "Robart", 1), ("Ashcraft", "Ashcroft", 1)}
    assert {(r.code, r.n) for r in spark.table("counts").collect()} == {(soundex_of("Robert"), 2), (soundex_of("Ashcraft"), 1)}
