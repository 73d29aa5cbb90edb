"""Column functions for string matching."""

from lexmesh.functions.arrays import ngrams
from lexmesh.functions.distance import damerau_levenshtein, levenshtein
from lexmesh.functions.normalize import strip_diacritics, unaccent
from lexmesh.functions.phonetic import double_metaphone, soundex
from lexmesh.functions.sql import register

__all__ = ["damerau_levenshtein", "double_metaphone", "levenshtein", "ngrams", "register", "soundex", "strip_diacritics", "unaccent"]
