import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `range` string, chunk int, label string, node string, `__mix_size` int, `__s_n_words` int, `__q_score` int, `__join_id` int"


@pytest.fixture(scope="session")
def small():
    """Rows (doc_id, text, lang, source) with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(9)
    syllables = "th an er in on re ed st ou ha é ö ß ci".split()
    rows, words = [], ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    for i in range(60):
        rows.append((i, text(rng.randrange(1, 120)), rng.choice(["en", "de"]), f"src{rng.choice([0, 0, 0, 1, 2, 10])}"))
    base = text(80).split(" ")
    for i in range(60, 90):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own), "en", "src0"))
    rows += [(90, None, None, None), (91, "", "en", "src1"), (92, " \t\n ", "en", "src1"), (93, "one two", "en", "src2"), (94, "One  TWO", "en", None), (95, rows[3][1], "en", "src1"), (95, rows[3][1], "en", "src1"), (96, text(4000), "en", "src2"), (97, "🎉 " * 30, "xx", "src10"), (98, "a" * 50_000, "en", "src0")]
    rows += [(200 + i, rows[62][1], "en", "src0") for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, small):
    """The rows as a table with more columns, whose names operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", 1, "y", "z", 5, 6, 7, 8) for i, t, g, s in small], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
