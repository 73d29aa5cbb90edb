import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from lexmesh.llm import fingerprints, host_reputation, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix(docs, small):
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, len(WORD.findall(t or ""))) for i, t, _, _ in small)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == size[r.source] for r in rows)
    # Water-filling by hand: weights 5, 2, 1 in code point order, null last, at most twice the size.
    names = [*sorted(s for s in size if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in names)
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in names)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_repeat(docs, empty):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source, r.size] += r.copies
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in out.collect())
    assert got == +copies
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_repeat_meets_its_targets_with_repeated_and_null_ids(spark, share):
    """Rows of one size, many of them with one id or none: what is emitted is what the mix takes."""
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else 7, f"text {i} " * 25, "ab"[i % 2]) if rng.random() < share else (1000 + i % 360, f"text {i} " * 25, "ab"[i % 3 == 0]) for i in range(400)]
    rows += [(5, "copy " * 50, "a")] * 40
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    taken, size, targets = Counter(), Counter(), {}
    for r in mixing.mix(table).collect():
        taken[r.source] += r.taken
        targets[r.source] = r.target
    emitted = mixing.repeat(table).collect()
    for r in emitted:
        size[r.source] += 50
    assert size == taken and all(abs(size[s] - t) <= 50 for s, t in targets.items())
    assert max(Counter(r.text for r in emitted if r.doc_id != 5).values()) <= 2
    assert 20 < sum(r.doc_id == 5 for r in emitted) <= 80


def test_urls(spark):
    good = [(i, f"http://Good.example.info/a/{i}?x", 1) for i in range(40)]
    bad = [(100 + i, f"https://bad.spam.test/p{i}#f", 0) for i in range(40)]
    more = [(200, "http://new.spam.test/x", None), (201, None, None), (202, "no scheme/com/en/", None), (203, "http://a.b.com/en/1", None), (204, "http://x.example.com/en/7z", None), (205, "http://example.com/en/8", None), (206, "http://notexample.com/en/7", None), (207, "http://example.net/de/81", None), (208, "ftp://Q.NET/de/", None), (209, "http://com?/en/", None), (210, "http://org/es/x", None), (210, "http://org/es/x", None), (211, "http://u.co.uk/\n/x", None)]
    pages = spark.createDataFrame([(i, u, "h", "host") for i, u, _ in good + bad + more], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad if q is not None] + [(5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = host_reputation.filter_urls(pages, labels).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(good + bad + more)
    assert got[0].host == "good.example.info" and got[0].path == "/a/0" and got[0].rule is None
    assert all(got[i].verdict == "allow" for i in range(40)) and all(got[100 + i].verdict == "block" for i in range(40))
    assert got[200].verdict == "block"  # by its domain
    assert (got[201].host, got[201].path, got[202].host, got[202].path) == ("", "", "", "")
    assert {i: got[i].rule for i in range(203, 212)} == {203: "com/en/", 204: "example.com/en/7", 205: "com/en/", 206: "com/en/", 207: "example.net/de/8", 208: "net/de/", 209: None, 210: "org/es/", 211: None}
    assert got[204].verdict == "allow" and got[207].verdict == "block" and got[209].host == "com" and got[209].path == ""
    con = duckdb.connect()
    p, l = pages.select("page_id", "url").toPandas(), labels.toPandas()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT * FROM p")
    con.execute("CREATE VIEW labels AS SELECT * FROM l")
    assert Counter(con.sql(host_reputation.ORACLE).fetchall()) == Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows)
    assert host_reputation.filter_urls(pages.limit(0), labels.limit(0)).count() == 0
    assert {r.verdict for r in host_reputation.filter_urls(pages, labels.limit(0)).where("page_id < 200").collect()} <= {"allow", "block"}


def test_each_rule_has_its_verdict(spark):
    """A url of each rule, on a host that outcomes judge the other way."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages, labels = [], []
    for i, (rule, verdict) in enumerate(want.items()):
        pages += [(100 * i + k, f"http://{rule}") for k in range(40)]
        labels += [(100 * i + k, int(verdict == "block")) for k in range(40)]
    got = host_reputation.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert Counter((r.rule, r.verdict) for r in got.collect()) == Counter({rule: 40 for rule in want.items()})


def canon(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


def digest(text):
    own = canon(text).encode()
    first, second = xxhash.xxh64_intdigest(own, 42), xxhash.xxh64_intdigest(own, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))
    return f"{first:016x}{second:016x}"


def edited(small):
    order = sorted(((i, t or "") for i, t, _, _ in small), key=lambda r: (-r[0], r[1]))
    for at, (i, text) in enumerate(order):
        other, half = order[(at + 1) % len(order)][1], len(text) // 2
        yield i, text, text[: len(text) - half] + other[:half], other


def test_digests(docs, small, empty):
    want = Counter()
    for i, text, edit, other in edited(small):
        want[i, len(text), hashlib.sha256(edit.encode()).hexdigest(), digest(text), digest(edit), float(canon(text) == canon(edit)), float(canon(text) == canon(other))] += 1
    assert Counter(map(tuple, fingerprints.fingerprint_edits(docs).collect())) == want
    assert {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprint(docs).collect()} == {(i, digest(t)) for i, t, _, _ in small}
    assert fingerprints.fingerprint_edits(empty).count() == 0
    assert fingerprints.fingerprint_edits(docs.where("doc_id = 3")).first().near_next == 1.0


def test_next_over_many_blocks(docs, small):
    rows = fingerprints.digested(docs)
    want = Counter((i, t, o, digest(t), digest(o)) for i, t, _, o in edited(small))
    for options in ({}, {"most_bounds": 3}, {"most_bounds": 1}, {"most_heads": 2}):
        got = fingerprints.with_next(rows, rows_per_block=7, **options).collect()
        assert Counter((r.doc_id, r.text, r.next_text, r.digest, r.next_digest) for r in got) == want


def test_next_of_ids_that_are_far_apart(spark):
    """Steps between bounds are uneven where ids are; the order holds all the same."""
    ids = [-(2**63), -(2**62) - 1, -5, 0, 1, 2, 3, 10**6, 2**62, 2**62 + 1, 2**63 - 2, 2**63 - 1] + [None, None]
    rows = [(i, f"{i} {k}") for k, i in enumerate(ids)]
    got = fingerprints.with_next(fingerprints.digested(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows_per_block=2, most_bounds=2).collect()
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert {r.text: r.next_text for r in got} == dict(zip(order, order[1:] + order[:1], strict=True))


def test_digests_that_collide_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "a", "d"), (2, "b", "d"), (3, "A", "d"), (4, "c", "e"), (5, "f", "g"), (6, "F ", "g")], "doc_id long, text string, digest string")
    for most in (1000, 1):
        variants = fingerprints.collisions(rows, most)
        told = fingerprints.told_apart(rows.withColumn("canon", fingerprints.canonical(rows.text)), variants, "canon", "digest")
        assert {(r.doc_id, r.digest) for r in told.collect()} == {(1, "d-1"), (2, "d-2"), (3, "d-1"), (4, "e"), (5, "g"), (6, "g")}
    assert fingerprints.collisions(rows.where("doc_id > 3")) is None


def test_canonical_forms_meet(spark):
    df = spark.createDataFrame([("Café  X",), (" café\tx ",), ("ﬁ",), ("FI",)], "text string")
    assert [r[0] for r in df.select(fingerprints.canonical(df.text)).collect()] == ["café x", "café x", "fi", "fi"]


def test_case_folding(spark):
    """Forms that lower-casing leaves apart."""
    texts = ["STRASSE", "straße", "ΟΔΟΣ", "οδος", "οδοσ", "İ", "i̇", "ŉ", "ʼn", "ᾳ", "ΑΙ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(fingerprints.canonical(df.text)).collect()] == [canon(t) for t in texts]
    assert canon("STRASSE") == canon("straße") and canon("ΟΔΟΣ") == canon("οδοσ") == canon("οδος")


def test_reputation_tells_hosts_apart(spark):
    """A host with many bad pages is blocked; one with few labels follows its domain, one without its suffix."""
    rows = [(f"h{i}.good.example.com", int(j > 0)) for i in range(20) for j in range(20)]
    rows += [(f"h{i}.bad.example.org", int(j > 15)) for i in range(20) for j in range(20)]
    rows += [("new.bad.example.org:8080", 1), ("me@new.good.example.com", 0), ("other.example.org", None), ("other.example.com", None)]
    df = spark.createDataFrame(rows, "host string, good int")
    found = {r.host: r for r in host_reputation.reputation(df).collect()}
    assert all(found[f"h{i}.good.example.com"].trusted and not found[f"h{i}.bad.example.org"].trusted for i in range(20))
    assert not found["new.bad.example.org:8080"].trusted and found["me@new.good.example.com"].trusted
    assert not found["other.example.org"].trusted and found["other.example.com"].trusted


def test_suffixes_of_a_file_and_addresses(spark, tmp_path):
    """Longest rule, wildcards, exceptions, hosts that are suffixes; an address is its own domain."""
    (tmp_path / "suffixes.txt").write_text("// a comment\n\ncom\nco.uk  British\nGITHUB.io\n*.ck\n!www.ck\n*.kawasaki.jp\n!city.kawasaki.jp\njp\n")
    rules = host_reputation.read_suffixes(spark, str(tmp_path / "suffixes.txt"))
    want = {
        "a.b.com": ("com", "b.com"), "com": ("com", "com"), "x.y.co.uk:80": ("co.uk", "y.co.uk"), "co.uk": ("co.uk", "co.uk"),
        "p.x.github.io": ("github.io", "x.github.io"), "me@y.github.io": ("github.io", "y.github.io"), "github.io": ("github.io", "github.io"),
        "a.b.c.ck": ("c.ck", "b.c.ck"), "ck": ("ck", "ck"), "c.ck": ("c.ck", "c.ck"), "a.www.ck": ("ck", "www.ck"),
        "u.v.w.kawasaki.jp": ("w.kawasaki.jp", "v.w.kawasaki.jp"), "a.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "kawasaki.jp": ("jp", "kawasaki.jp"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.9.0.1:8080": ("10.9.0.1", "10.9.0.1"), "[2001:db8::1]:80": ("[2001:db8::1]", "[2001:db8::1]"),
        "1.2.3.4.example": ("example", "4.example"), "": ("", ""), "odd..name": ("name", ".name"), "localhost": ("localhost", "localhost"),
    }
    hosts = spark.createDataFrame([(h, 1) for h in want], "host string, n int")
    assert {r.host: (r.suffix, r.domain) for r in host_reputation.with_domains(hosts, rules).collect()} == want
    few = {r.host: r.suffix for r in host_reputation.with_domains(hosts).collect()}
    assert few["x.y.co.uk:80"] == "co.uk" and few["p.x.github.io"] == "io" and few["10.0.0.1"] == "10.0.0.1"
    assert {r.suffix for r in host_reputation.with_domains(hosts, ()).collect()} >= {"uk", "com", "io"}
    with pytest.raises(ValueError, match="suffix rules"):
        host_reputation.suffix_rules(spark, rules, most=2)


def test_the_threshold_follows_the_common_rate(spark):
    """Where half of all pages are bad, hosts of the common rate stay; where few are, such a host goes."""
    def trusted(rest):
        rows = [("half.example.com", j % 2) for j in range(200)] + [(f"h{i}.example.org", int(j % 100 < rest)) for i in range(10) for j in range(200)]
        return {r.host: r.trusted for r in host_reputation.reputation(spark.createDataFrame(rows, "host string, good int")).collect()}

    assert trusted(50)["half.example.com"] and not trusted(95)["half.example.com"] and trusted(95)["h3.example.org"]


def test_bad_addresses_do_not_spoil_others(spark):
    rows = [("10.0.0.1", 0)] * 50 + [("10.9.0.1", None)] + [(f"h{i}.example.org", 1) for i in range(50)]
    found = {r.host: r.trusted for r in host_reputation.reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert not found["10.0.0.1"] and found["10.9.0.1"] and found["h1.example.org"]
