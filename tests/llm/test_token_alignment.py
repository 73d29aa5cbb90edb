import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexmesh.llm import token_alignment
from lexmesh.llm.token_alignment import Aligner, aligned, link_counts, token_map

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a  b   c ", "a▁b", "<|endoftext|> x", "<s> </s> <unk>", "日本語のテキスト 日本", "🎉🎉 ok", "a\0b", "x\n\n\ty\r\n z", "ﬁ ½ é", " x　y", "don't we'll", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ÄÖÜ ßen", "́ é", "1234567 12 3"]


def plain(rows):
    """The contract's columns, step by step, from the libraries' own encodings; rows of (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer

    bpe, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    bpe.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}

    def a_bytes(i):
        return bytes(letters[c] for c in bpe.id_to_token(i)) if i != 50256 else b""

    def b_bytes(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    found, held = [], Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a, b = (bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            a = b = []
        a_ends, b_ends, at = [], [], 0
        for ends, ids, spell in ((a_ends, a, a_bytes), (b_ends, b, b_bytes)):
            at = 0
            for i in ids:
                at += len(spell(i))
                ends.append(at)
        shared = sorted(set(a_ends) & set(b_ends))
        groups, last = [], 0
        for end in shared:
            groups.append(([i for i, e in zip(a, a_ends, strict=True) if last < e <= end], [i for i, e in zip(b, b_ends, strict=True) if last < e <= end]))
            last = end
        links = [(x, y) for g, h in groups for x in g for y in h]
        held.update(set(links))
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(((i, na, nb, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest) for i, na, nb, g, links, digest in found), key=repr)


@pytest.mark.parametrize("most_pairs", [3_000_000, 0])
def test_equals_brute_force(spark, docs, small, monkeypatch, most_pairs):
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", most_pairs)
    odd = spark.createDataFrame([(1000 + i, t, "en", "s", 1, "x", 1, "y", "z", 5, 6, 7, 8) for i, t in enumerate(ODD)] + [(None, "the text", *docs.head()[2:])], docs.schema)
    want = plain([(i, t) for i, t, _, _ in small] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "the text")])
    got = sorted((tuple(r) for r in link_counts(docs.unionByName(odd), A, B).collect()), key=repr)
    assert got == want


def test_long_groups_count_distinct_ids(monkeypatch):
    texts = ["日本語のテキスト 🎉🎉🎉🎉 don't aaaaaaaa", "the house"]
    want = Aligner(A, B).rows(texts)
    monkeypatch.setattr(token_alignment, "MOST_LINKS", 1)
    got = Aligner(A, B).rows(texts)
    assert got[1] == want[1] and all((x == y).all() for x, y in zip(got[2:], want[2:], strict=True))


def test_windows_are_remembered_and_forgotten(monkeypatch):
    own = Aligner(A, B)
    first = own.rows(["the house the house the house", None, ""])
    seen = len(own.windows.texts)
    assert seen < 6
    again = own.rows(["the house the house the house", None, ""])
    assert len(own.windows.texts) == seen and again[1] == first[1] and (again[0] == first[0]).all()
    monkeypatch.setattr(token_alignment, "MOST_WINDOWS", 1)
    assert own.rows(["a house the house", None, ""])[1][0].startswith("257|264;") and own.windows.full()


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    want = Aligner(A, B).rows(["the old house of the old man", "an old house"])
    monkeypatch.setattr(token_alignment, "mixed", lambda h: h * 0)
    got = Aligner(A, B).rows(["the old house of the old man", "an old house"])
    assert got[1] == want[1] and got[3].tolist() == want[3].tolist()


def test_groups_and_map(spark, docs, empty):
    rows = aligned(docs, A, B)
    assert rows.where(F.sha2("groups", 256) != F.col("groups_sha256")).where("n_a > 0").count() == 0
    found = {r.a_id: r.b_id for r in token_map(spark.createDataFrame([(1, "the house of the man"), (2, "the man")], "doc_id long, text string"), A, B).collect()}
    assert found[262] == 272  # " the"
    assert link_counts(empty, A, B).collect() == [] and token_map(empty, A, B).collect() == []
