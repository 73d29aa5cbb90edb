"""Canonical exact digests of texts.

The canonical text is the NFKC form with case folded (ß and ss, ς and σ are one), in NFKC
again, blanks folded to single spaces and trimmed. Its fingerprint is a 128-bit digest from two differently seeded 64-bit xxhash
values. Texts with equal digests are grouped by digest and canonical bytes, so that two
canonical texts that share a digest are seen, and get fingerprints with distinct suffixes.
The grouping compares whole bytes in the aggregation's hash table and combines equal
texts before the shuffle: a group of copies sends one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmesh.llm.shared import materialise


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again, each run of Unicode blanks one space, trimmed; null counts as empty.

    Of ASCII texts (as many bytes as characters) all this leaves lower-casing and blanks to do.
    """
    text = F.coalesce(text, F.lit(""))

    def composed(x: Column) -> Column:
        return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.when(plain, F.regexp_replace(F.lower(text), r"\s+", " ")).otherwise(F.regexp_replace(composed(folded), r"(?U)\s+", " ")))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the digest of its canonical form, written: each text is folded once."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return materialise(with_digest(rows, "text", "digest"), "digests")


def with_digest(rows: DataFrame, text: str, name: str) -> DataFrame:
    """The digest of a text column; its canonical form is a projection of its own, so that it is worked out once."""
    return rows.withColumn("folded", canonical(F.col(text))).withColumn(name, digest(F.col("folded"))).drop("folded")


def digest(canon: Column) -> Column:
    """32 hex digits: xxhash64 of the text and xxhash64 from another seed."""
    def wide(h: Column) -> Column:
        return F.lpad(F.lower(F.hex(h)), 16, "0")

    return F.concat(wide(F.xxhash64(canon)), wide(F.xxhash64(F.lit(1), canon)))


def fingerprint(docs: DataFrame, resolve: bool = True) -> DataFrame:
    """Fingerprint of every row of ``docs`` (``doc_id``, ``text``): doc_id, fingerprint.

    Null and empty texts share the empty text's fingerprint; rows whose canonical texts are
    equal have equal fingerprints. If ``resolve``, digests that different canonical texts share
    are told apart by a suffix, in order of their bytes. Repeated ids are rows like any other.
    """
    if not resolve:
        return with_digest(docs.select("doc_id", "text"), "text", "fingerprint").select("doc_id", "fingerprint")
    rows = digested(docs)
    variants = collisions(rows)
    if variants is not None:
        rows = told_apart(rows.withColumn("canon", canonical(F.col("text"))), variants, "canon", "digest")
    return rows.select("doc_id", F.col("digest").alias("fingerprint"))


def collisions(rows: DataFrame, most: int = 1_000_000) -> DataFrame | None:
    """(digest, canon, suffix) of canonical texts of ``rows`` (text, digest) that share a digest; None if there are none.

    Texts whose digest no other row has need no comparison. Up to ``most`` digests of several rows (some 50
    bytes each) are counted and then broadcast, so that only their texts are folded and compared; beyond
    that all texts are.
    """
    several = materialise(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest"), "buckets")
    n = several.count()
    if not n:
        return None
    suspects = rows.join(F.broadcast(several), "digest", "left_semi") if n <= most else rows
    texts = suspects.select("digest", canonical(F.col("text")).alias("canon")).groupBy("digest", "canon").agg(F.count(F.lit(1)).alias("n")).select("digest", "canon")
    shared = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    if shared.isEmpty():
        return None
    order = Window.partitionBy("digest").orderBy("canon")
    return texts.join(shared, "digest", "left_semi").withColumn("suffix", F.concat(F.lit("-"), F.row_number().over(order)))


def told_apart(rows: DataFrame, variants: DataFrame, canon: str, name: str) -> DataFrame:
    v = variants.select(F.col("digest").alias("v_digest"), F.col("canon").alias("v_canon"), "suffix")
    both = rows.join(v, (F.col(name) == F.col("v_digest")) & (F.col(canon) == F.col("v_canon")), "left")
    return both.withColumn(name, F.concat(name, F.coalesce("suffix", F.lit("")))).drop("v_digest", "v_canon", "suffix")


def with_next(rows: DataFrame, rows_per_block: int = 4000, most_bounds: int = 20_000, most_heads: int = 1_000_000) -> DataFrame:
    """Each of ``rows`` (see :func:`digested`) with the text and the digest of the next one in descending order of id (the last: the first).

    Rows of equal id follow one another by text; null ids come last. Returns doc_id, text, digest,
    next_text, next_digest. The ids' quantiles (at most ``most_bounds``) and, between two of them, even steps
    cut the table into blocks of about ``rows_per_block`` rows; rows with the top id of a block also go
    to the block before, as the text that its last row needs, so each text is shuffled about once and
    no task holds the whole order. One task orders a row of three numbers for each block. Rows of one
    id, and those without one, stand in one block.
    """
    n, top, bottom = rows.agg(F.count(F.lit(1)), F.max("doc_id"), F.min("doc_id")).first()
    if not n:
        return rows.withColumn("next_text", F.col("text")).withColumn("next_digest", F.lit(""))
    blocks = max(1, min(most_bounds, -(-n // rows_per_block)))
    cuts = rows.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks)).first()[0] or []
    bounds = sorted({int(x) for x in cuts} if blocks > 1 else set())
    # Block 0 has null ids, block k + 1 the ids from the k-th bound on (a binary search).
    steps = max(1, len(bounds).bit_length())
    table = F.array(*map(F.lit, bounds)).cast("array<bigint>")

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        over = (acc["lo"] < acc["hi"]) & (F.get(table, mid) <= acc["x"])
        return F.struct(acc["x"].alias("x"), F.when(over, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when((acc["lo"] < acc["hi"]) & ~over, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.col("doc_id").alias("x"), F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"] + 1 if bounds else F.lit(1)
    # Steps between two bounds: a stretch's place in doubles never falls as the id grows.
    fine = -(-n // (blocks * rows_per_block))
    edges = F.array(*map(F.lit, [bottom or 0, *bounds, top or 0])).cast("array<double>")
    low, high, place = F.get(edges, F.col("coarse") - 1), F.get(edges, F.col("coarse")), F.col("doc_id").cast("double")
    step = F.when(high > low, F.least(F.lit(fine - 1), F.floor((place - low) / (high - low) * fine))).otherwise(F.lit(0))
    rows = rows.withColumn("coarse", found)
    rows = rows.withColumn("block", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("coarse") * fine + (step if fine > 1 else F.lit(0))).cast("long")).drop("coarse")
    # The ids that open a block, one for each, and the block that comes before it in the order.
    heads = rows.select("block", "doc_id").groupBy("block").agg(F.max("doc_id").alias("head"))
    before = heads.withColumn("to", F.lag("block").over(Window.orderBy(F.col("block").desc())))
    last = heads.agg(F.min("block").alias("last"))
    to = before.join(F.broadcast(last)).select(F.col("block").alias("head_block"), "head", F.coalesce("to", "last").alias("to"), F.col("to").isNull().alias("wraps"))
    # A row of four small columns for each block, broadcast up to a counted number.
    to = materialise(to, "heads")
    marked = rows.join(F.broadcast(to) if to.count() <= most_heads else to, (F.col("block") == F.col("head_block")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("block"), F.lit(True).alias("guest"))
    at = F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest)))
    sent = marked.select("doc_id", "text", "digest", at.alias("at")).select("doc_id", "text", "digest", "at.block", "at.guest")
    # Both in one window over plain columns: another window, or a struct, would shuffle the texts twice.
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    following = sent.select("*", F.lead("text").over(order).alias("next_text"), F.lead("digest").over(order).alias("next_digest")).where("NOT guest")
    return following.select("doc_id", "text", "digest", F.coalesce("next_text", "text").alias("next_text"), F.coalesce("next_digest", "digest").alias("next_digest"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness.

    The edited text is the text whose last ``floor(n_chars / 2)`` code points are replaced by the
    first as many (or all) of the next document's (see :func:`with_next`). A likeness is 1.0 if
    the fingerprints are equal, else 0.0. Texts of ``docs`` that share a digest are told apart by their
    bytes, an edited text is compared with those. Null texts count as empty; rows with one id are each
    other's next in order of text; an empty table gives an empty result; a single row is its own next.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    own = digested(docs)
    rows = with_next(own).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows, variants = with_digest(rows, "edited", "edited_digest"), collisions(own)
    if variants is not None:
        for text, name in (("text", "digest"), ("next_text", "next_digest"), ("edited", "edited_digest")):
            rows = told_apart(rows.withColumn("canon", canonical(F.col(text))), variants, "canon", name).drop("canon")
    # What two columns compare is worked out once, in the projection below this one.
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "next_digest")

    def same(a: str, b: str) -> Column:
        return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.lit(0.0))

    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_digest").alias("near_next"))
