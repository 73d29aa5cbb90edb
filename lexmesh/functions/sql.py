"""SQL names of the functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexmesh.functions import distance, normalize, phonetic

_TYPED_NGRAMS = {"decimal": "DECIMAL(38, 18)"} | {t: t.upper() for t in "string boolean tinyint smallint int bigint float double date timestamp timestamp_ntz binary".split()}


class Ngrams:
    """N-grams of an array of any type, as a table function of one row: ``FROM t, LATERAL ngrams(t.items, 2)``.

    The type of the result follows the array's when the query is analysed, and so do errors: the first
    argument has to be an array or NULL, n a constant positive whole number.
    """

    @staticmethod
    def analyze(items: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        kind = items.dataType
        if not isinstance(kind, T.ArrayType | T.NullType):
            raise ValueError("ngrams: the first argument must be an array")
        if not n.isConstantExpression:
            raise ValueError("ngrams: n must be a constant")
        if isinstance(n.value, bool) or not isinstance(n.value, int) or n.value <= 0:
            raise ValueError("ngrams: n must be positive")
        of = kind if isinstance(kind, T.ArrayType) else T.ArrayType(T.StringType())
        return AnalyzeResult(T.StructType([T.StructField("ngrams", T.ArrayType(of))]))

    def eval(self, items, n):
        yield (None if items is None else [items[i : i + n] for i in range(len(items) - n + 1)],)


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``.

    ``strip_diacritics``, ``unaccent``, ``double_metaphone`` and ``damerau_levenshtein(a, b[, k])`` have
    their own names; ``lk_soundex`` and ``lk_levenshtein(a, b[, k])`` differ from Spark's built-ins of the
    name without prefix. Arrays of any type have the table function :class:`Ngrams`, ``ngrams(array, n)``; those of plain types also
    ``ngrams_<type>(array, n)``, an expression without Python, which raises where n is null or not positive.
    """
    spark.udtf.register("ngrams", udtf(Ngrams))
    spark.udf.register("double_metaphone", phonetic._metaphone)
    spark.udf.register("__damerau", distance._damerau)
    letters = "upper(regexp_replace(substring_index(s, '\\0', 1), '[^A-Za-z]', ''))"
    digits = f"regexp_replace(translate({letters}, '{phonetic.LETTERS}', '{phonetic.SOUNDEX_DIGITS}'), '([0-9])\\\\1+', '$1')"
    code = f"rpad(concat(substr({letters}, 1, 1), substr(replace(substr({digits}, 2), '0', ''), 1, 3)), 4, '0')"
    soundex = f"CASE WHEN {letters} = '' THEN '0000' ELSE {code} END"
    capped = "levenshtein(a, b, CAST(least(greatest(k, 0), 2147483647) AS INT))"
    levenshtein = f"CASE WHEN k IS NULL THEN NULL WHEN k < 0 THEN levenshtein(a, b) WHEN {capped} = -1 THEN k + 1 ELSE {capped} END"
    for head, returns, body in (
        ("lk_soundex(s STRING)", "STRING", soundex),
        ("strip_diacritics(s STRING)", "STRING", normalize.sql_strip_diacritics("s")),
        ("unaccent(s STRING)", "STRING", normalize.sql_unaccent("s")),
        ("lk_levenshtein(a STRING, b STRING, k BIGINT DEFAULT -1)", "BIGINT", levenshtein),
        ("damerau_levenshtein(a STRING, b STRING, k BIGINT DEFAULT -1)", "BIGINT", "__damerau(a, b, k)"),
        *((f"ngrams_{name}(a ARRAY<{kind}>, n INT)", f"ARRAY<ARRAY<{kind}>>", "CASE WHEN n IS NULL OR n <= 0 THEN raise_error('ngrams: n must be positive') WHEN a IS NULL THEN NULL WHEN size(a) < n THEN array() ELSE transform(sequence(1, greatest(size(a) - n + 1, 1)), i -> slice(a, i, n)) END") for name, kind in _TYPED_NGRAMS.items()),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
