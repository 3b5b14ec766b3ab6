"""Text functions: Column -> Column, all built from Spark's own expressions but `nfkd_ascii`, `stemmed`
and `tabs_expanded`, which SQL functions can't express (Arrow user functions)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches

MASK = "DPNUM"


def strip_spaces(c: Column) -> Column:
    """Without leading and trailing spaces; other white space stays."""
    return F.trim(c)


def strip_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_line(c: Column) -> Column:
    """Newlines become spaces, carriage returns go."""
    return F.translate(c, "\n\r", " ")


def without_breaks(c: Column) -> Column:
    return F.translate(c, "\r\n\t", "")


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+", MASK)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]+", "")


def digits_number(c: Column) -> Column:
    """All digits of a text as one number of up to 38 digits; null without digits or beyond."""
    bare = F.regexp_replace(digits_only(c), "^0+(?=[0-9])", "")
    return F.when(F.length(bare).between(1, 38), bare.try_cast("decimal(38,0)"))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def latin1_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\xFF]", "")


def printable_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x20-\x7E\t-\r]", "")


def unsigned_hex_of_signed_crc(c: Column) -> Column:
    """Hex of the signed CRC-32 with its sign dropped, as old runtimes printed it."""
    v = F.crc32(F.encode(c, "utf-8"))
    return F.lower(F.hex(F.when(v >= (1 << 31), F.lit(1 << 32) - v).otherwise(v)))


def count_of(c: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n", -1)).cast("long")


def longest_digit_run(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")


def has_run_between(c: Column, least: int, most: int) -> Column:
    """1 if a whole run of digits is longer than `least` and shorter than `most`."""
    runs = F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    return F.exists(runs, lambda r: (F.length(r) > least) & (F.length(r) < most)).cast("long")


def all_caps(word: Column) -> Column:
    """At least one cased letter and none in lower case."""
    return (word == F.upper(word)) & (word != F.lower(word))


def _plain_words(c: Column, stop_words: list[str]) -> Column:
    """Words of a-z in lower case, digit runs as the mask, without stop words."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", MASK.lower()), r"[^a-z\s]", "")
    return F.filter(F.split(F.regexp_replace(kept, r"\s+", " "), " "), lambda w: (w != "") & ~w.isin(stop_words))


def _mask_words(words: Column) -> Column:
    """The words in one line; any that begins with the mask becomes the mask."""
    mask = MASK.lower()
    return F.array_join(F.transform(words, lambda w: F.when(w.startswith(mask), mask).otherwise(w)), " ")


def normalised(c: Column, stop_words: list[str], stem: bool = False) -> Column:
    """Lower case; digit runs masked; letters a-z and spaces alone; stop words and blanks out; with `stem`
    the stems of the words; any word that begins with the mask becomes the mask."""
    words = _plain_words(c, stop_words)
    return _mask_words(stemmed(words) if stem else words)


def tokens(c: Column, stop_words: list[str]) -> Column:
    """Stems of the lower-case words, without stop words and bare numbers; a null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\w+)"), F.lit(1))
    return stemmed(F.filter(words, lambda w: ~w.isin(stop_words) & ~w.rlike("^[0-9]+$")))


def ascii_tokens(c: Column) -> Column:
    """Stems of the words of a text's printable ASCII; stop words stay."""
    return tokens(printable_ascii(F.coalesce(c, F.lit(""))), [])


def escaped(c: Column) -> Column:
    """Tabs, line breaks and backslashes as two-character escapes."""
    for plain, letter in (("\\", "\\"), ("\t", "t"), ("\n", "n"), ("\r", "r")):
        c = F.replace(c, F.lit(plain), F.lit("\\" + letter))
    return c


def has_caps_word(c: Column) -> Column:
    """1 if some word has two or more letters and is all in capitals."""
    return F.exists(F.split(c, r"\s+"), lambda w: all_caps(w) & (F.length(w) > 1)).cast("long")


def file_name(c: Column) -> Column:
    """Letters, digits and . _ - of a URL, at most 128 characters."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", ""), 1, 128)


@F.pandas_udf(T.StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then ASCII alone."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def tabs_expanded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.expandtabs())


# Words whose stems are given, not found.
GIVEN_STEMS = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# The endings of Porter's algorithm, as later extended, and what stands in their place, by step.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    return _kinds(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word).endswith("c")


def _short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y; or a vowel and a consonant alone."""
    kinds = _kinds(word)
    return kinds == "vc" or (kinds.endswith("cvc") and word[-1] not in "wxy")


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _stem(word: str) -> str:
    """Porter's stemmer with its common extensions, on a word in lower case: y becomes i only after a consonant that isn't the word's
    first letter, words of four letters in ies and ied keep ie, and some words have given stems."""
    if word in GIVEN_STEMS:
        return GIVEN_STEMS[word]
    if len(word) < 3:
        return word
    plural = {"sses": "ss", "ies": "ie" if len(word) == 4 else "i", "ss": "ss", "s": ""}
    if (end := _ending(word, plural)) is not None:
        word = word[: -len(end)] + plural[end]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (end := _ending(word, ("ed", "ing"))) and "v" in _kinds(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and len(word) > 2 and _kinds(word[:-1]).endswith("c"):
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]):
        word = word[:-2]
    for step in (dict(STEP_2), dict(STEP_3)):
        if (end := _ending(word, step)) and _measure(word[:-3] if end == "logi" else word[: -len(end)]):
            word = word[: -len(end)] + step[end]
    if (end := _ending(word, STEP_4)) and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("l") and _doubled(word) and _measure(word) > 1:
        word = word[:-1]
    return word


#: Bytes of words that a worker takes at a time.
STEM_BYTES = 1 << 20


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}  # of one batch
    stem = lambda w: known[w] if w in known else known.setdefault(w, _stem(w))
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stemmed(words: Column) -> Column:
    bound_batches(SparkSession.active(), STEM_BYTES)
    return _stems(words)


def language_or_null(c: Column, detected: Column, least: int = 64) -> Column:
    """A caller's detected language; null for texts under `least` characters."""
    return F.when(F.length(c) >= least, detected)
