"""The registered queries of the library, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions import damerau_levenshtein, double_metaphone, levenshtein, ngrams, soundex, strip_diacritics, unaccent
from lexmesh.functions import phonetic as ph
from lexmesh.operators import as_of_join, best_match, block_graph, block_pairs, estimates, fuzzy_anti, fuzzy_join, fuzzy_semi, merged, metaphone_keys, near_values, nearest, soundex_keys, value_sketches, values_of
from lexmesh.operators.linkage import ranked_matches
from lexmesh.sources import all_words, read_table


def sql_soundex(word: str) -> str:
    """Soundex in ANSI SQL; runs of digits are folded one by one, as there are no back-references."""
    letters = f"upper(regexp_replace({word}, '[^A-Za-z]', '', 'g'))"
    digits = f"translate({letters}, '{ph.LETTERS}', '{ph.SOUNDEX_DIGITS}')"
    for d in "0123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '0000' ELSE rpad(left({letters}, 1) || left(replace(substr({digits}, 2), '0', ''), 3), 4, '0') END"


def sql_words(table: str, text: str) -> str:
    return f"SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {table})"


def sql_distance(name: str, a: str, b: str) -> str:
    """Distances in SQL count bytes: each lower-case letter of Latin-1 takes the place of one that no word has.

    For words with other letters the SQL would count bytes; the tables have none, and tests hold such words to brute force.
    """
    latin = "".join(chr(i) for i in range(0xDF, 0x100) if i != 0xF7)
    bytes_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&+"
    return f"{name}(translate({a}, '{latin}', '{bytes_}'), translate({b}, '{latin}', '{bytes_}'))"


def levenshtein_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", levenshtein("p_name", "p_type").alias("distance"))


def levenshtein_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", levenshtein("p_name", "p_type", 12).alias("distance"))


def levenshtein_column_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", levenshtein("p_name", "p_type", F.col("p_size") - 5).alias("distance"))


def damerau_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", damerau_levenshtein("p_name", "p_type").alias("distance"))


def damerau_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", damerau_levenshtein("p_name", "p_type", 12).alias("distance"))


def ngrams_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.split(F.col("p_type"), "")
    return read_table(spark, sf_dir, "part").select("p_partkey", F.posexplode(ngrams(letters, 3)).alias("place", "gram")).select("p_partkey", F.col("place").cast("bigint").alias("place"), F.array_join("gram", "").alias("gram"))


def soundex_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_words(read_table(spark, sf_dir, "documents"), "text").select("word", soundex("word").alias("code"))


def soundex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = all_words(read_table(spark, sf_dir, "documents"), "text").select(soundex("word").alias("code"))
    return coded.select(F.substring("code", 1, 1).alias("initial"), "code").rollup("initial", "code").agg(F.count(F.lit(1)).alias("n_words"))


def strip_diacritics_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", strip_diacritics("text").alias("folded"))


def unaccent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", unaccent("text").alias("folded"))


def double_metaphone_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_words(read_table(spark, sf_dir, "documents"), "text").select("word", F.array_join(double_metaphone("word"), "/").alias("codes"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = all_words(read_table(spark, sf_dir, "benchmark"), "text").withColumnRenamed("word", "left_word")
    return left, all_words(read_table(spark, sf_dir, "conversations"), "text").withColumnRenamed("word", "right_word")


def block_soundex_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_pairs(*_sides(spark, sf_dir), "left_word", "right_word", soundex_keys)


def block_metaphone_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_pairs(*_sides(spark, sf_dir), "left_word", "right_word", metaphone_keys)


def fuzzy_join_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_join(*_sides(spark, sf_dir), "left_word", "right_word", 1)


def fuzzy_join_damerau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_join(*_sides(spark, sf_dir), "left_word", "right_word", 1, metric="damerau")


def fuzzy_semi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_semi(*_sides(spark, sf_dir), "left_word", "right_word", 1)


def fuzzy_anti_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_anti(*_sides(spark, sf_dir), "left_word", "right_word", 1)


def best_match_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_match(*_sides(spark, sf_dir), "left_word", "right_word", 3, soundex_keys)


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """Distinct lines (column ``line``) of a text column."""
    return df.select(F.explode(F.split(F.col(text), "\n")).alias("line")).distinct()


def near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations within 4 edits of lines of documents: whole lines, mostly long ones."""
    left = values_of(text_lines(read_table(spark, sf_dir, "conversations"), "text"), "line")
    return near_values(left, values_of(text_lines(read_table(spark, sf_dir, "documents"), "text"), "line"), 4)


def fuzzy_join_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls within 6 edits of each other, transpositions among them."""
    urls = values_of(read_table(spark, sf_dir, "pages"), "url")
    return near_values(urls, urls, 6, "damerau").withColumnsRenamed({"left_value": "left_url", "right_value": "right_url"})


def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(*_sides(spark, sf_dir), "left_word", "right_word")


#: Double Metaphone codes of words that are common in the tables; fixed values.
COMMON = {
    "the": "0/T", "of": "AF", "and": "ANT", "to": "T", "in": "AN", "a": "A", "is": "AS", "that": "0T/TT", "for": "FR", "it": "AT", "as": "AS", "was": "AS/FS", "with": "A0/FT", "be": "P", "by": "P", "on": "AN",
    "are": "AR", "from": "FRM", "this": "0S/TS", "an": "AN", "at": "AT", "or": "AR", "than": "0N/TN", "then": "0N/TN", "thin": "0N/TN", "thing": "0NK/TNK", "thor": "0R/TR", "de": "T", "la": "L", "des": "TS", "que": "K",
    "ing": "ANK", "tion": "XN", "ble": "PL", "ther": "0R/TR", "sh": "X", "wh": "A", "ha": "H", "ou": "A", "er": "AR", "es": "AS", "ed": "AT", "re": "R", "st": "ST", "nd": "NT", "he": "H", "erin": "ARN",
}


def metaphone_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of common words, and in how many texts each is."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    words = read_table(spark, sf_dir, "documents").select(F.explode(found).alias("word")).where(F.col("word").isin(list(COMMON)))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.select("word", F.array_join(double_metaphone("word"), "/").alias("codes"), "n_docs")


def metaphone_common_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words of both sides that share a code."""
    left, right = (side.where(F.col(side.columns[0]).isin(list(COMMON))) for side in _sides(spark, sf_dir))
    return block_pairs(left, right, "left_word", "right_word", metaphone_keys)


def graph_keys(word):
    """Soundex code, start and end of a word."""
    return F.array(F.concat(F.lit("s:"), soundex(word)), F.concat(F.lit("b:"), F.substring(word, 1, 3)), F.concat(F.lit("e:"), F.right(word, F.lit(3))))


def weighted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_graph(*_sides(spark, sf_dir), "left_word", "right_word", graph_keys, [F.char_length, lambda w: F.substring(w, 1, 2)], 20, 3)


def sql_block_graph(most: int, keep: int) -> str:
    """The rule of the block graph with the same keys, level by level."""

    def keys(side: str) -> str:
        return f"SELECT DISTINCT word, unnest(['s:' || {sql_soundex('word')}, 'b:' || left(word, 3), 'e:' || right(word, 3)]) AS code FROM {side}"

    sql = f"WITH l AS ({_LEFT}), r AS ({_RIGHT}), a0 AS ({keys('l')}), b0 AS ({keys('r')})"
    for i, part in enumerate(["length(word)::VARCHAR", "left(word, 2)", "word"]):
        sql += f", n{i} AS (SELECT code, count(*) AS n FROM b{i} GROUP BY code)"
        for x in "ab":
            sql += f", {x}{i + 1} AS (SELECT word, code || chr(31) || {part} AS code FROM {x}{i} WHERE code IN (SELECT code FROM n{i} WHERE n > {most}))"
    sql += ", n3 AS (SELECT code, count(*) AS n FROM b3 GROUP BY code)"
    pairs = " UNION ALL ".join(f"SELECT a{i}.word AS left_value, b{i}.word AS right_value, 1000000 // n AS weight FROM a{i} JOIN b{i} ON a{i}.code = b{i}.code JOIN n{i} ON n{i}.code = b{i}.code{f' WHERE n <= {most}' if i < 3 else ''}" for i in range(4))
    edges = f"SELECT left_value, right_value, count(*) AS n_codes, sum(weight)::BIGINT AS weight FROM ({pairs}) GROUP BY ALL"
    return sql + f" SELECT * FROM ({edges}) QUALIFY rank() OVER (PARTITION BY left_value ORDER BY weight DESC) <= {keep}"


def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the last order of its user up to then."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return as_of_join(events, orders, "user_id", "o_custkey", "ts", "o_orderdate", 30 * 86_400).select("event_id", "o_orderkey", "o_totalprice")


def last_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last click of the same user up to then."""
    events = read_table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts"))
    return as_of_join(bought, clicks, "user_id", "click_user", "ts", "click_ts").select("event_id", "click_id")


def soundex_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by Soundex code in sketches, merged to initials: how many, how many distinct ones, the most frequent ones."""
    words = read_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    # Each distinct word is coded once.
    codes = words.distinct().select(F.col("word").alias("own"), soundex("word").alias("code"))
    sketches = value_sketches(words.join(codes, F.col("word") == F.col("own")), "word", "code")
    return estimates(merged(sketches, F.substring("code", 1, 1).alias("initial")), 3).select("initial", "n", "n_distinct", F.to_json("top").alias("top"))


def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_matches(*_sides(spark, sf_dir), "left_word", "right_word", 3, soundex_keys, 3).select("left_value", "right_value", "distance", F.col("rank").cast("bigint").alias("rank"))


_LEFT, _RIGHT = sql_words("benchmark", "text"), sql_words("conversations", "text")
_PAIRS = f"WITH l AS ({_LEFT}), r AS ({_RIGHT}), p AS (SELECT l.word AS left_value, r.word AS right_value FROM l JOIN r ON {sql_soundex('l.word')} = {sql_soundex('r.word')})"
_NEAR = f"WITH l AS ({_LEFT}), r AS ({_RIGHT})"
_MARKS = "".join(map(chr, [*range(1, 9), *range(14, 32)]))


def sql_text_distance(name: str, a: str, b: str) -> str:
    """As :func:`sql_distance` for whole texts, in which control characters take the place of the letters."""
    letters = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
    return f"{name}(translate({a}, '{letters}', '{_MARKS[:len(letters)]}'), translate({b}, '{letters}', '{_MARKS[:len(letters)]}'))"


def sql_lines(table: str) -> str:
    return f"SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM {table}"


_LINE_DISTANCE = sql_text_distance("levenshtein", "l.line", "r.line")
_FOLD = "strip_accents(text)"

QUERIES = {
    "levenshtein": (levenshtein_exact, "SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance FROM part"),
    "levenshtein_threshold": (levenshtein_capped, "SELECT p_partkey, least(levenshtein(p_name, p_type), 13)::BIGINT AS distance FROM part"),
    "levenshtein_column_threshold": (levenshtein_column_cap, "SELECT p_partkey, CASE WHEN p_size < 5 THEN levenshtein(p_name, p_type) ELSE least(levenshtein(p_name, p_type), p_size - 4) END::BIGINT AS distance FROM part"),
    "damerau_levenshtein": (damerau_exact, "SELECT p_partkey, damerau_levenshtein(p_name, p_type)::BIGINT AS distance FROM part"),
    "damerau_levenshtein_threshold": (damerau_capped, "SELECT p_partkey, least(damerau_levenshtein(p_name, p_type), 13)::BIGINT AS distance FROM part"),
    "ngrams": (ngrams_of_names, "SELECT p_partkey, i::BIGINT AS place, substr(p_type, i + 1, 3) AS gram FROM (SELECT p_partkey, p_type, unnest(range(0, length(p_type) - 2)) AS i FROM part)"),
    "soundex": (soundex_words, f"SELECT word, {sql_soundex('word')} AS code FROM ({sql_words('documents', 'text')})"),
    "soundex_groups": (soundex_groups, f"SELECT left(code, 1) AS initial, code, count(*) AS n_words FROM (SELECT {sql_soundex('word')} AS code FROM ({sql_words('documents', 'text')})) GROUP BY ROLLUP (left(code, 1), code)"),
    "strip_diacritics": (strip_diacritics_texts, f"SELECT doc_id, {_FOLD} AS folded FROM documents"),
    "unaccent": (unaccent_texts, "SELECT doc_id, replace(replace(replace(replace(replace(translate(strip_accents(text), 'ØøÐðŁłĐđ', 'OoDdLlDd'), 'ß', 'ss'), 'Æ', 'AE'), 'æ', 'ae'), 'Œ', 'OE'), 'œ', 'oe') AS folded FROM documents"),
    "double_metaphone": (double_metaphone_words, None),
    "metaphone_common_words": (metaphone_common_words, f"WITH c(word, codes) AS (VALUES {', '.join(str(x) for x in COMMON.items())}), w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS word FROM documents) SELECT c.word, c.codes, count(*) AS n_docs FROM c JOIN w ON c.word = w.word GROUP BY ALL"),
    "metaphone_common_pairs": (metaphone_common_pairs, f"WITH c(word, codes) AS (VALUES {', '.join(str(x) for x in COMMON.items())}), l AS (SELECT c.* FROM c JOIN ({_LEFT}) w ON c.word = w.word), r AS (SELECT c.* FROM c JOIN ({_RIGHT}) w ON c.word = w.word) SELECT l.word AS left_value, r.word AS right_value FROM l, r WHERE list_has_any(string_split(l.codes, '/'), string_split(r.codes, '/'))"),
    "weighted_block_graph": (weighted_blocks, sql_block_graph(20, 3)),
    "as_of_join": (last_orders, "WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL) SELECT event_id, o_orderkey, o_totalprice FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate"),
    "as_of_self_join": (last_clicks, "WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT e.event_id, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts"),
    "soundex_sketches": (soundex_sketches, None),
    "block_soundex_join": (block_soundex_join, f"{_PAIRS} SELECT * FROM p"),
    "block_metaphone_join": (block_metaphone_join, None),
    "fuzzy_join": (fuzzy_join_words, f"{_NEAR} SELECT l.word AS left_word, r.word AS right_word, {sql_distance('levenshtein', 'l.word', 'r.word')}::BIGINT AS distance FROM l, r WHERE {sql_distance('levenshtein', 'l.word', 'r.word')} <= 1"),
    "fuzzy_join_damerau": (fuzzy_join_damerau, f"{_NEAR} SELECT l.word AS left_word, r.word AS right_word, {sql_distance('damerau_levenshtein', 'l.word', 'r.word')}::BIGINT AS distance FROM l, r WHERE {sql_distance('damerau_levenshtein', 'l.word', 'r.word')} <= 1"),
    "fuzzy_semi_join": (fuzzy_semi_words, f"{_NEAR} SELECT l.word AS left_word FROM l WHERE EXISTS (SELECT 1 FROM r WHERE {sql_distance('levenshtein', 'l.word', 'r.word')} <= 1)"),
    "fuzzy_anti_join": (fuzzy_anti_words, f"{_NEAR} SELECT l.word AS left_word FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE {sql_distance('levenshtein', 'l.word', 'r.word')} <= 1)"),
    "near_lines": (near_lines, f"WITH l AS ({sql_lines('conversations')}), r AS ({sql_lines('documents')}) SELECT l.line AS left_value, r.line AS right_value, {_LINE_DISTANCE}::BIGINT AS distance FROM l JOIN r ON length(r.line) BETWEEN length(l.line) - 4 AND length(l.line) + 4 WHERE {_LINE_DISTANCE} <= 4"),
    "fuzzy_join_far": (fuzzy_join_far, "WITH u AS (SELECT DISTINCT url FROM pages) SELECT l.url AS left_url, r.url AS right_url, damerau_levenshtein(l.url, r.url)::BIGINT AS distance FROM u l, u r WHERE damerau_levenshtein(l.url, r.url) <= 6"),
    "nearest_value": (nearest_words, f"{_NEAR} SELECT l.word AS left_value, r.word AS right_value, {sql_distance('levenshtein', 'l.word', 'r.word')}::BIGINT AS distance FROM l, r QUALIFY distance = min(distance) OVER (PARTITION BY left_value)"),
    "best_match": (best_match_words, f"{_PAIRS}, d AS (SELECT *, {sql_distance('levenshtein', 'left_value', 'right_value')}::BIGINT AS distance FROM p) SELECT left_value, right_value, distance FROM d WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY left_value ORDER BY distance, right_value) = 1"),
    "top_matches": (top_matches, f"{_PAIRS}, d AS (SELECT *, {sql_distance('levenshtein', 'left_value', 'right_value')}::BIGINT AS distance FROM p) SELECT left_value, right_value, distance, row_number() OVER (PARTITION BY left_value ORDER BY distance, right_value) AS rank FROM d WHERE distance <= 3 QUALIFY rank <= 3"),
}
