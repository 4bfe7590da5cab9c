"""Text columns: cleaning, segmentation and the two tokenizers. All native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The literal replacements of the cleaning step, in the order they apply.
CLEANING_LITERALS = [
    ("'s", " 's"),
    ("'ve", " 've"),
    ("n't", " n't"),
    ("'re", " 're"),
    ("'d", " 'd"),
    ("'ll", " 'll"),
    ("!", " ! "),
    ("(", " ( "),
    (")", " ) "),
    ("?", " ? "),
    ("$", " $ "),
    ("%", " % "),
]

# Token patterns. A word character is a letter, a number or "_"; combining marks
# are not, which is why these classes are spelled out instead of using (?U)\w.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
ENCODER_PATTERN = r"['\p{L}\p{N}_-]+"
SEGMENT_PATTERN = r"[\p{L}\p{N}_]+|\S"
HAN_RUN_PATTERN = r"([\x{4E00}-\x{9FA5}\p{IsHan}]+)"
# Most Han letters are in the first range, which spares looking up the script of each.
HAN_LETTER = r"[\x{4E00}-\x{9FA5}[\x{2E80}-\x{10FFFF}&&\p{IsHan}&&[\p{L}\p{N}]]]"
# A pair of Han letters, of which one is left for the next pair, or a word of other characters.
NOT_HAN = r"[\p{L}\p{N}_&&[^\p{IsHan}]]"
PAIRED_WORD_PATTERN = f"(?=({HAN_LETTER}{{2}}|{NOT_HAN}{{2,}}))(?:{HAN_LETTER}|{NOT_HAN}+)"
# The white space that stripping removes, and characters among which all Han ones are.
BLANKS = " \t\n\x0b\f\r"
MAY_BE_HAN = r"[\x{2E80}-\x{10FFFF}]"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it.

    The value becomes the element of a one-element array, and so a lambda variable.
    """
    return F.transform(F.array(value), body)[0]


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clean_text(text: Column) -> Column:
    """Lower-case text with contractions split off and ``! ( ) ? $ %`` set apart by blanks.

    Runs of blanks shrink to one, and any blank-separated piece holding ``xx`` or ``XX`` becomes
    ``xxx``. ``Xx`` does not count as such a pair.
    """
    out = text
    for old, new in CLEANING_LITERALS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"\s{2,}", " ")
    return F.lower(F.btrim(_bound(out, _without_doubled_x), F.lit(BLANKS)))


def _without_doubled_x(text: Column) -> Column:
    """Most texts have no such pair, so the pattern is tried only where a plain search finds one.

    The look-behind starts a match only where a piece starts, so long pieces stay linear.
    """
    found = text.contains("xx") | text.contains("XX")
    return F.when(found, F.regexp_replace(text, r"(?<!\S)\S*(?:xx|XX)\S*", "xxx")).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case tokens of at least two word characters."""
    return _all_matches(F.lower(text), WORD_PATTERN)


def encoder_words(text: Column) -> Column:
    """Tokens of word characters, apostrophes and hyphens, for text that is lower-case already."""
    return _all_matches(text, ENCODER_PATTERN)


def blank_count(text: Column) -> Column:
    """Number of pieces when split at every single blank."""
    return F.size(F.split(text, " "))


def paired(text: Column) -> Column:
    """``text`` with every run of two or more Han characters as its overlapping pairs, set apart by blanks.

    Han text has no blanks between words, and pairs need no dictionary. Only a text with a character
    high enough to be Han is looked at, and it is rewritten by patterns, not piece by piece.
    """
    apart = F.regexp_replace(text, HAN_RUN_PATTERN, " $1 ")
    # A character and the next one; the last one of a run has been in a pair already.
    pairs = F.regexp_replace(apart, f"({HAN_LETTER})(?=({HAN_LETTER}))|(?<={HAN_LETTER}){HAN_LETTER}", "$1$2 ")
    return F.when(text.rlike(MAY_BE_HAN), pairs).otherwise(text)


def paired_words(text: Column) -> Column:
    """``words(paired(text))`` by one pass of a pattern over the text.

    Only a final sigma is in lower case by what surrounds it, so only there must runs be apart before.
    """
    apart = F.when(text.contains("Σ"), F.regexp_replace(text, HAN_RUN_PATTERN, " $1 ")).otherwise(text)
    found = F.regexp_extract_all(F.lower(apart), F.lit(PAIRED_WORD_PATTERN), F.lit(1))
    return F.when(text.rlike(MAY_BE_HAN), found).otherwise(words(text))


def segments(text: Column) -> Column:
    """Words and single punctuation marks; a run of Han characters gives its overlapping pairs."""
    return _all_matches(paired(text), SEGMENT_PATTERN)


def segmented(text: Column) -> Column:
    """``segments`` joined by one blank, made by one replacement."""
    return F.btrim(F.regexp_replace(paired(text), rf"({SEGMENT_PATTERN})\s*", "$1 "), F.lit(BLANKS))


def term_frequencies(tokens: Column) -> Column:
    """Distinct terms of one token array with their counts: ``array<struct<term, tf>>``.

    The array is sorted and cut where the term changes, so counting happens inside the row and
    needs no shuffle.
    """

    def cut(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda _, i: i),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return _bound(starts, lambda s: F.transform(s, lambda a, k: one(ordered, s, a, k)))

    def one(ordered: Column, starts: Column, start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(ordered))
        return F.struct(
            F.get(ordered, start).alias("term"), (end - start).cast("long").alias("tf")
        )

    return _bound(F.sort_array(tokens), cut)


def term_places(tokens: Column) -> Column:
    """Distinct terms with all their positions from 0: ``array<struct<term, positions>>``.

    The same cut as in ``term_frequencies``, over pairs of term and position.
    """
    pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))

    def cut(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda _, i: i),
            lambda i: (i == 0) | (F.get(ordered, i)["term"] != F.get(ordered, i - 1)["term"]),
        )
        return _bound(starts, lambda s: F.transform(s, lambda a, k: one(ordered, s, a, k)))

    def one(ordered: Column, starts: Column, start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(ordered))
        return F.struct(
            F.get(ordered, start)["term"].alias("term"),
            F.slice(ordered, start + 1, end - start)["pos"].alias("positions"),
        )

    return _bound(F.sort_array(pairs), cut)
