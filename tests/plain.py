"""Plain versions of what the functions work out, for comparison."""

from lexmesh.functions import phonetic


def soundex_of(text):
    out, last = "", ""
    for char in text.split("\0", 1)[0].encode().decode("ascii", "ignore").upper():
        if char in phonetic.LETTERS:
            digit = phonetic.SOUNDEX_DIGITS[phonetic.LETTERS.index(char)]
            if not out:
                out = char
            elif digit not in ("0", last):
                out += digit
            last = digit
    return out[:4].ljust(4, "0")


def levenshtein_of(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(left + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]
