import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmesh.functions import damerau_levenshtein, double_metaphone, levenshtein, ngrams, register, soundex, strip_diacritics, unaccent
from lexmesh.functions.distance import banded, damerau, least_distance
from lexmesh.functions.normalize import LUMPS
from lexmesh.functions.phonetic import METAPHONE as RULES_OF
from lexmesh.functions.phonetic import PROPERTIES, SILENT, cleaned, metaphone, metaphones
from plain import levenshtein_of, soundex_of

SOUNDEX = {
    "Robert": "R163", "John": "J500", "Will": "W400", "William": "W450", "James": "J520", "Charles": "C642", "George": "G620", "Joseph": "J210", "Richard": "R263", "Thomas": "T520",
    "Edward": "E363", "Henry": "H560", "Walter": "W436", "Arthur": "A636", "Fred": "F630", "Albert": "A416", "Samuel": "S540", "David": "D130", "Louis": "L200", "Joe": "J000",
    "Charlie": "C640", "Clarence": "C465", "Andrew": "A536", "Daniel": "D540", "Ernest": "E652", "Jesse": "J200", "Oscar": "O260", "Lewis": "L200", "Peter": "P360", "Émilie": "M400",
    None: None, "": "0000", " ": "0000", "Ashcraft": "A226", "Pfister": "P236", "12": "0000", "ab\0cd": "A100",
}
STRIPPED = {
    None: None, "": "", "Jürgen Thérèse": "Jurgen Therese", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ": "aaaaaaceeeeiiiinooooouuuuyy", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ": "AAAAAACEEEEIIIINOOOOOUUUUYY",
    "Ærøskøbing, Groß, Œuvre": "Ærøskøbing, Groß, Œuvre", "Łódź, Reykjavík": "Łodz, Reykjavik", "Hello world 123!@#": "Hello world 123!@#",
    "François-Marie d'Arrouët, dit VOLTAIRE (né le 21/11/1694)": "Francois-Marie d'Arrouet, dit VOLTAIRE (ne le 21/11/1694)", "ﬁ ²": "fi 2", "½": "1/2", "a–b — c": "a-b - c", "‘x’": "'x'", "a\0b": "ab"[:1],
}
UNACCENTED = {
    None: None, "": "", "Jürgen Thérèse": "Jurgen Therese", "Ærøskøbing": "AEroskobing", "Großes Straßenschild": "Grosses Strassenschild", "Œil, œuvre": "OEil, oeuvre",
    "Þór, Björn, Łódź": "Thor, Bjorn, Lodz", "Ærøskøbing éëôÉ Łódź ß": "AEroskobing eeoE Lodz ss", "Hello World 123😊": "Hello World 123😊", "ẞ ı": "ẞ ı",
}
METAPHONE = {
    None: None, "": [], "  ": [], "123": [], "Smith": ["SM0", "XMT"], "Schmidt": ["XMT", "SMT"], "Johnson": ["JNSN", "ANSN"], "Jackson": ["JKSN", "AKSN"], "Jose": ["JS", "HS"], "Raj": ["RJ", "R "],
    "Thomas": ["TMS"], "Van Gogh": ["FNKK"], "Hemptah": ["HMPT"], "1ier": ["R"], "Ñandú": ["NNT"], "Émilie": ["ML"], "İstanbul": ["STNPL"], "Пётр": ["NNN"],
}
LEVENSHTEIN = [
    ("rhvoqmisbooteswjx", "rhvoqmisbocteswjx", -1, 1), ("ryytfqhpwfxccetntkidsft", "ryyfqhpwfxccettidsf", -1, 4), ("ryytfqhpwfxccetntkidsft", "ryyfqhpwfxccettidsf", 1, 2), ("eexcjpsemiujnpcjxfpozund", "ejpseiujnjxfpzn", 9, 9),
    ("ejepvkyljzrhxygbbkyoigqzj", "ejepvkljygbkyoigzj", 9, 7), ("kqlprvccxluel", "tqfsgltyzrbh{hhkull", 7, 8), ("kqlprvccxluel", "tqfsgltyzrbh{hhkull", -1, 14), ("café☕", "cafe", -1, 2), ("café☕", "cafe", 1, 2),
    ("qvgvwqrdbzscoysedhurmmje{rktcm{", "hunrxrnq", -1, 28), ("kitten", "sitting", -1, 3), ("kitten", "sitting", 2, 3), ("Saturday", "Sunday", -1, 3), ("hello", "helo", 2, 1), ("a", "b", 0, 1), ("a", "a", 0, 0),
    (None, "a", -1, None), ("a", None, 2, None), ("a", "b", None, None), ("a", "b", 2**63 - 1, 1), ("", "abc", -1, 3),
]
DAMERAU = [
    ("iupnyjmguebdgljcovqkhjumysjbgprhnlihjixbzacdtcnm", "iuqnjmeglcovqjhjumysbghnhjxbzacdtcpf", -1, 16), ("iupnyjmguebdgljcovqkhjumysjbgprhnlihjixbzacdtcnm", "iuqnjmeglcovqjhjumysbghnhjxbzacdtcpf", 7, 8),
    ("yfzt{qmvdyfmbjokavnclorkdjf", "mhom{nzjbglufbpace", -1, 24), ("yfzt{qmvdyfmbjokavnclorkdjf", "mhom{nzjbglufbpace", 9, 10), ("boub{joqgtpdettgevaunwnnuhbvrxjwh", "wxb{jqgtdehtvevwnnbxw", -1, 16),
    ("mbychdsoijtlsnplffltuotsztynsivoqkszyuwbedmhz", "mcdojtlnplfltuttszynsiwkszyujbudmz", -1, 15), ("emm", "ylbmsuiaixaomnfljgigfnxoiecuchrhwwqfnu", -1, 36), ("café☕", "cafe", -1, 2), ("café☕", "cafe", 2, 2),
    ("CA", "AC", -1, 1), ("hello", "ehllo", -1, 1), ("CA", "ABC", -1, 2), (None, "a", -1, None), ("a", "b", None, None), ("ab", "ba", 0, 1), ("", "", -1, 0), ("a", "b", 2**31, 1),
]


def one_column(spark, cases, kind):
    return spark.createDataFrame([(k,) for k in cases], f"x {kind}")


@pytest.mark.parametrize(("function", "cases"), [(soundex, SOUNDEX), (strip_diacritics, STRIPPED), (unaccent, UNACCENTED), (double_metaphone, METAPHONE)])
def test_goldens(spark, function, cases):
    rows = one_column(spark, cases, "string").select("x", function("x").alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


@pytest.mark.parametrize(("function", "cases"), [(levenshtein, LEVENSHTEIN), (damerau_levenshtein, DAMERAU)])
def test_distances(spark, function, cases):
    df = spark.createDataFrame(cases, "a string, b string, k bigint, want bigint")
    assert df.where(~function("a", "b", F.col("k")).eqNullSafe(F.col("want"))).count() == 0
    for a, b, k, want in cases:
        assert df.limit(1).select(function(F.lit(a), F.lit(b), k)).first()[0] == want


@pytest.mark.parametrize("function", [levenshtein, damerau_levenshtein])
def test_golden_distances(spark, function):
    lines = (Path(__file__).parent / "goldens" / f"{function.__name__}.tsv").read_text().splitlines()[1:]
    rows = [(a, b, int(k) if k else -1, int(want)) for a, b, k, want in (line.split("\t") for line in lines)]
    assert len(rows) == 100
    df = spark.createDataFrame(rows, "a string, b string, k long, want long")
    assert [tuple(r) for r in df.where(~function("a", "b", F.col("k")).eqNullSafe(F.col("want"))).collect()] == []


def slow_damerau(a, b):
    """Unrestricted distance by its recursion over matching last characters."""
    d = {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            k = max((x for x in range(1, i) if a[x - 1] == b[j - 1]), default=0)
            m = max((y for y in range(1, j) if b[y - 1] == a[i - 1]), default=0)
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1) if k and m else 10**6)
    return d[len(a), len(b)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", max_size=8), st.text("abcd", max_size=8)), min_size=1, max_size=8), st.integers(-1, 5))
def test_damerau_is_unrestricted(pairs, k):
    got = damerau([a for a, _ in pairs], [b for _, b in pairs], [k] * len(pairs))
    want = [slow_damerau(a, b) for a, b in pairs]
    assert all(least_distance(a, b) <= w for (a, b), w in zip(pairs, want, strict=True))
    assert got == [w if k < 0 else min(w, k + 1) for w in want]
    assert all(levenshtein_of(a, b) / 2 <= w <= levenshtein_of(a, b) for (a, b), w in zip(pairs, want, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=14), st.text("abc", min_size=1, max_size=14)), min_size=1, max_size=6), st.integers(1, 15))
def test_bands_hold_every_path_within_them(pairs, w):
    assert banded(pairs, w).tolist() == [min(slow_damerau(a, b), w + 1) for a, b in pairs]


def test_long_strings_take_a_band_only():
    import time
    import tracemalloc

    rng = random.Random(6)

    def edited(text, n):
        out = list(text)
        for _ in range(n):
            i = rng.randrange(len(out) - 1)
            out[i : i + 2] = rng.choice([out[i + 1 : i - 1 if i else None : -1][:2], out[i : i + 1], [*out[i : i + 2], "x"], ["y", out[i + 1]]])
        return "".join(out)

    texts = ["".join(rng.choice("abcdefghij") for _ in range(3000)) for _ in range(1000)]
    others = [edited(t, rng.randrange(25)) for t in texts]
    tracemalloc.start()
    began = time.time()
    found = damerau(texts, others, [20] * 1000)
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert all(least_distance(a, b) <= d for a, b, d in zip(texts, others, found, strict=True) if d <= 20) and min(found) <= 1 and max(found) >= 15
    some = [(texts[i][:40], others[i][:40]) for i in range(40)]
    assert damerau([a for a, _ in some], [b for _, b in some], [20] * 40) == [min(slow_damerau(a, b), 21) for a, b in some]
    began = time.time()
    assert damerau([texts[0] * 5], [texts[1][::-1] * 5], [100]) == [101] and time.time() - began < 10


def test_ngrams(spark):
    df = spark.sql("SELECT array('a', 'b', 'c', 'd') s, array(1, NULL, 3) i, array(true, false) b, array(1.5, 2.7, 3.14) d, cast(NULL AS array<int>) z, cast(array() AS array<int>) e")
    row = df.select(ngrams("s", 3).alias("s"), ngrams("i", 2).alias("i"), ngrams("b", 2).alias("b"), ngrams("d", 2).alias("d"), ngrams("z", 2).alias("z"), ngrams("e", 2).alias("e"), ngrams("b", 5).alias("few"), ngrams("s", 1).alias("one")).first()
    assert row.s == [["a", "b", "c"], ["b", "c", "d"]] and row.i == [[1, None], [None, 3]] and row.b == [[True, False]]
    assert [[str(x) for x in y] for y in row.d] == [["1.50", "2.70"], ["2.70", "3.14"]]
    assert row.z is None and row.e == [] and row.few == [] and row.one == [["a"], ["b"], ["c"], ["d"]]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ngrams("s", bad)
    for bad in (None, 1.5, True, "2"):
        with pytest.raises(TypeError):
            ngrams("s", bad)


def test_metaphone_agrees_with_another_implementation(spark):
    """Spark ships an encoder of the same family; blanks and JOSE are told apart on purpose."""
    import random

    rng, codec = random.Random(4), spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    codec.setMaxCodeLen(6)
    parts = "A E I O U Y B C CH CZ CC CIA D DG F G GH GN GE GLI H J K L LL LLO M MB N P PH Q R RR S SC SCH SH SIO SZ T TH TION TCH V W WICZ WR WH X Z ZH ZZ UMB IER AIS OIS EAUX ISL SUGAR CAESAR CHAR CHIA ACH DANGER MAC MC ALLE EWSKI ZO AGGI".split()
    words = {"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(3000)}
    different = []
    for word in sorted(w for w in words if "JOSE" not in w):
        want = [c for c in dict.fromkeys((codec.doubleMetaphone(word, False), codec.doubleMetaphone(word, True))) if c]
        if metaphone(word) != want:
            different.append((word, metaphone(word), want))
    assert not different, different[:10]


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT lk_soundex('Ashcraft') a, lk_levenshtein('kitten', 'sitting') b, lk_levenshtein('kitten', 'sitting', 2) c, lk_levenshtein('a', 'b', NULL) d, unaccent('Þór') e, strip_diacritics('é') f, double_metaphone('Smith') g, damerau_levenshtein('CA', 'ABC') h, damerau_levenshtein('kitten', 'sitting', 1) i, ngrams_string(array('a', 'b', 'c'), 2) j, lk_soundex(NULL) k, lk_soundex('') l").first()
    assert tuple(row) == ("A226", 3, 3, None, "Thor", "e", ["SM0", "XMT"], 2, 2, [["a", "b"], ["b", "c"]], None, "0000")


def test_sql_ngrams_of_every_type(spark):
    register(spark)
    row = spark.sql("SELECT ngrams_decimal(array(1.5, 2.7, 3.14, 4.0), 2) d, ngrams_boolean(array(true, false, true), 2) b, ngrams_date(array(date'2020-01-01'), 1) t, ngrams_float(cast(array() AS array<float>), 2) e, ngrams_int(NULL, 2) z, ngrams_smallint(array(1S, NULL), 2) s").first()
    assert [[float(x) for x in y] for y in row.d] == [[1.5, 2.7], [2.7, 3.14], [3.14, 4.0]] and row.b == [[True, False], [False, True]]
    assert [[str(x) for x in y] for y in row.t] == [["2020-01-01"]] and row.e == [] and row.z is None and row.s == [[1, None]]
    for n in ("0", "-1", "NULL"):
        with pytest.raises(Exception, match="n must be positive"):
            spark.sql(f"SELECT ngrams_string(array('a', 'b'), {n})").collect()


def test_sql_ngrams_of_any_type_at_one_name(spark):
    register(spark)
    spark.sql("SELECT 1 id, array(array(1), array(2, NULL), NULL) a, array(struct('x' AS s, 1.5 AS d), struct('y' AS s, 2.5 AS d)) b, array('p', 'q', 'r') c UNION ALL SELECT 2, NULL, cast(array() AS array<struct<s:string,d:decimal(2,1)>>), array('z')").createOrReplaceTempView("lists")
    rows = spark.sql("SELECT id, x.ngrams x, y.ngrams y, z.ngrams z FROM lists, LATERAL ngrams(a, 2) x, LATERAL ngrams(b, 1) y, LATERAL ngrams(c, 2) z ORDER BY id")
    assert [rows.schema[i].dataType.simpleString() for i in (1, 2, 3)] == ["array<array<array<int>>>", "array<array<struct<s:string,d:decimal(2,1)>>>", "array<array<string>>"]
    one, two = rows.collect()
    assert one.x == [[[1], [2, None]], [[2, None], None]] and [[(e.s, float(e.d)) for e in g] for g in one.y] == [[("x", 1.5)], [("y", 2.5)]] and one.z == [["p", "q"], ["q", "r"]]
    assert two.x is None and two.y == [] and two.z == []
    assert spark.sql("SELECT * FROM ngrams(NULL, 2)").first().ngrams is None
    for wrong, message in (("array(1), 0", "positive"), ("array(1), -1", "positive"), ("array(1), NULL", "positive"), ("'a', 1", "must be an array"), ("array(1), true", "positive")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM ngrams({wrong})")  # when analysed, before any row is read
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM lists, LATERAL ngrams(c, id)")


def test_stripping_is_the_decomposition_of_every_character(spark):
    import unicodedata

    lumps = {c: to for to, own in LUMPS.items() for c in own}

    def plain(text):
        kinds = {"Zs": " ", "Pd": "-", "Pc": "_"}
        return "".join(lumps.get(c) or kinds.get(unicodedata.category(c), c) for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M")

    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(f"é{c}x",) for c in chars], "t string")
    register(spark)
    df.select("t", strip_diacritics("t").alias("s")).createOrReplaceTempView("folded")
    assert [(r.t, r.s) for r in spark.table("folded").collect() if r.s != plain(r.t)] == []
    assert spark.sql("SELECT * FROM folded WHERE NOT strip_diacritics(t) <=> s").count() == 0


def test_metaphones_of_a_batch_walk_by_the_rules():
    """The walk of a batch against a plain one that tries the ways of one word's rules place by place."""
    rng = random.Random(7)
    parts = "A E I O U Y B C CH CZ CC CIA D DG F G GH GN GE GLI H J K L LL LLO ALLE ALLES ALLEO M MB N P PH Q R RR S SC SCH SH SIO SZ T TH TION V W WICZ WR X Z ZH ZZ ç Ñ ğ İ é 1 - 日".split()
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 7))) for _ in range(1500)]
    words += ["".join(chr(rng.randrange(1, 0x250)) for _ in range(rng.randrange(0, 12))) for _ in range(500)]

    def fits(data, at, way):
        def all_in(needs):
            return all(allowed[data[at + place]] for place, allowed in needs)

        return all_in(way.needs) and not any(all_in(ban) for ban in way.bans)

    def plain(word):
        data = b"\n" * 8 + cleaned(word) + b"\n" * 8
        end = len(data) - 8
        known = {name for name, tried in PROPERTIES.items() if any(fits(data, at, w) for at in range(8, end) for w in tried)}
        codes, at = ["", ""], 8 + any(fits(data, 8, w) for w in SILENT if end > 8)
        while at < end:
            found = next(((r, w) for r in RULES_OF.get(chr(data[at]), ()) if (not r.when or r.when in known) and r.unless not in known for w in r.ways if fits(data, at, w)), None)
            if found:
                codes = [codes[0] + found[0].primary.decode(), codes[1] + found[0].alternate.decode()]
            at += found[1].size if found else 1
        return [c for c in dict.fromkeys(c[:6] for c in codes) if c]

    assert metaphones([*words, None]) == [*map(plain, words), None]


def test_plain_soundex():
    assert all(soundex_of(k) == v for k, v in SOUNDEX.items() if k is not None)


def test_native_plans(spark):
    df = one_column(spark, ["a"], "string").select(soundex("x"), strip_diacritics("x"), unaccent("x"), levenshtein("x", F.lit("b"), 3), ngrams(F.split("x", ""), 2))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
