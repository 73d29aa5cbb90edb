import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmesh.llm.personal_data import KINDS, detected, find_personal, luhn, normalised, personal, redact, span_digests

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's patterns as they stand, matches that fail dropped."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return [(k, s, e) for s, k, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("01259.+@-() ax", max_size=60), st.lists(st.sampled_from(["a.b@c.de", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "411111111111111", "+1 (974) 555-3436", " ", "0", "+", "-", "x", "00255.1.1.1", "é"]), max_size=12).map("".join)))
def test_base_is_the_patterns_as_they_stand(text):
    assert detected(text) == plain(text)
    kept = [(s.kind, s.start, s.end) for s in personal(text) if not s.disguised]
    assert kept == [(KINDS[k], s, e) for k, s, e in plain(text)]


DISGUISED = {
    "john dot doe at example dot com": ("email", "john.doe@example.com"), "user (at) example (dot) com": ("email", "user@example.com"), "user[at]example[.]com": ("email", "user@example.com"), "USER {AT} EXAMPLE {DOT} ORG": ("email", "USER@EXAMPLE.ORG"),
    "user＠example．com": ("email", "user@example.com"), "uѕer@exаmple.com": ("email", "user@example.com"), "us​er@exam\xadple.com": ("email", "user@example.com"), "user @ example . com": ("email", "user@example.com"), "user@example dot co dot uk": ("email", "user@example.co.uk"),
    "user&#64;example&#46;com": ("email", "user@example.com"), "und.55 at mail4.example.com": ("email", "und.55@mail4.example.com"), "ana arroba correo punto es": ("email", "ana@correo.es"), "info (ät) firma (punkt) de": None,
    "plus one five five five one two three four five six seven": ("phone", "+15551234567"), "plus 1 (974) 555-3436": ("phone", "+1 (974) 555-3436"), "+1 （974） 555‑3436": ("phone", "+1 (974) 555-3436"), "plus four nine double three one two one two one two": ("phone", "+4933121212"), "+٤٩ ١٢٣ ٤٥٦ ٧٨٩": ("phone", "+49 123 456 789"),
    "192 dot 168 dot 1 dot 10": ("ip", "192.168.1.10"), "10[.]0[.]0[.]1": ("ip", "10.0.0.1"), "l92.168.O.1": ("ip", "192.168.0.1"), "one nine two dot one six eight dot one dot one": ("ip", "192.168.1.1"), "eins neun zwei punkt eins sechs acht punkt null punkt eins": ("ip", "192.168.0.1"), "１９２。１６８。０。１": ("ip", "192.168.0.1"),
    "four one one one one one one one one one one one one one one one": ("card", "4111111111111111"), "４１１１ １１１１ １１１１ １１１１": ("card", "4111 1111 1111 1111"), "4111–1111–1111–1111": ("card", "4111-1111-1111-1111"), "4111 one one one one 1111 1111": ("card", "4111 1111 1111 1111"), "4l11 1111 1111 1l11": ("card", "4111 1111 1111 1111"),
}


@pytest.mark.parametrize(("before", "after"), [("", ""), ("Ça é 🎉 ", " und so weiter."), ("x\n", "\ny")])
@pytest.mark.parametrize(("disguised", "want"), DISGUISED.items())
def test_disguises_are_found_where_they_stand(disguised, want, before, after):
    text = before + disguised + after
    got = [(s.kind, text[s.start : s.end], s.value, s.disguised) for s in personal(text)]
    assert got == ([(want[0], disguised, want[1], True)] if want else [])


CLEAN = ["Look at the dot product of a point in space at example.com.", "un deux trois nous irons au bois", "One, two, three: go!", "At three dot four he left.", "Version 1.2.3 (at) line 10", "2001–2005 and 2006–2010", "see a @ b", "hello @user.name", "he has double five", "Der Punkt ist: eins plus eins ist zwei.", "mail9 l0 O2 10l", "Ｆｕｌｌ ｗｉｄｔｈ ①②③", "fİve one two three", "​​", "100% at 50 dots", "zero one two three four five six seven"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert personal(text) == []


def test_base_spans_stay_beside_added_ones():
    text = "mail a.b@c.de or john dot doe@example.com, 4111 1111 1111 1111 or four one one one one one one one one one one one one one one one"
    got = [(s.kind, text[s.start : s.end], s.disguised) for s in personal(text)]
    assert got == [("email", "a.b@c.de", False), ("email", "doe@example.com", False), ("card", "4111 1111 1111 1111", False), ("card", text[text.index("four") :], True)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["one", "dot", "at", " ", " ", "@", "．", "(at)", "[.]", "com", "x1", "plus", "٣", "​", "double", "O0", "é", "5", "-", "&#64;", "İ", "😀", "un"]), max_size=25).map("".join))
def test_every_character_stands_for_a_stretch_of_the_source(text):
    normal = normalised(text)
    if normal is None:
        return
    assert len(normal.text) == len(normal.starts) == len(normal.ends) == len(normal.changed)
    assert all(0 <= s < e <= len(text) for s, e in zip(normal.starts, normal.ends, strict=True))
    assert list(normal.starts) == sorted(normal.starts) and list(normal.ends) == sorted(normal.ends)
    assert all(c == text[s:e] for c, s, e, new in zip(normal.text, normal.starts, normal.ends, normal.changed, strict=True) if not new)


def test_time_is_linear():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1(" * 100_000, "1 " * 150_000, "a.b at " * 40_000, "one two " * 40_000, "x dot " * 50_000, "( at " * 60_000, "é" + "@a." * 80_000, "plus 1 " * 40_000, "O1" * 100_000):
        personal(text)
    assert time.time() - began < 60


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("79927398713")


def test_tables(spark, docs, small, empty):
    rng = random.Random(3)
    extra = [(500 + i, f"{rng.choice(['ja', 'é', ''])} {d} {rng.choice(['ok', ''])}", *docs.head()[2:]) for i, d in enumerate(DISGUISED)] + [(None, "a.b@c.de", *docs.head()[2:])]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = [(i, t) for i, t, _, _ in small] + [(r[0], r[1]) for r in extra]

    def line(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    want = [(i, *(sum(k == x for k, _, _ in plain(t)) for x in range(4)), hashlib.sha256(line(plain(t)).encode()).hexdigest(), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in personal(t)), sum(s.disguised for s in personal(t))) for i, t in rows]
    got = [tuple(r) for r in span_digests(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert span_digests(empty).collect() == [] and find_personal(empty).collect() == []
    redacted = {r.doc_id: r.text for r in redact(table).select("doc_id", "text").where("doc_id IS NULL OR doc_id = 500 OR doc_id = 90").collect()}
    assert redacted[None] == "<EMAIL>" and "<EMAIL>" in redacted[500] and "doe" not in redacted[500] and redacted[90] is None
    assert redact(table).columns == table.columns
