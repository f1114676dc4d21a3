"""Text normalisation, validation and native error rates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# Characters that survive normalisation (letters, numbers,
# underscore, apostrophe, hyphen) and the accepted raw length of a text.
KEPT_CHARACTERS = r"\p{L}\p{N}_'\-"
MIN_TEXT_CHARS = 1
MAX_TEXT_CHARS = 2000

# The characters that count as white space, ASCII and beyond.
WHITE_SPACE = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# One supplementary code point per distinct word, so that a word edit distance
# is a string edit distance; a pair with more distinct words than that fails.
_FIRST_WORD_CODE = 0x10000
_MAX_WORDS = 0x10FFFF - _FIRST_WORD_CODE


def normalise_text(text: Column) -> Column:
    """Lower-case, turn everything but word characters, ``'`` and ``-`` into
    single spaces, strip."""
    return F.trim(F.regexp_replace(F.lower(text), f"[^{KEPT_CHARACTERS}]+", " "))


def split_words(text: Column) -> Column:
    """Whitespace words; an empty or blank text has none."""
    stripped = F.trim(F.regexp_replace(text, f"{WHITE_SPACE}+", " "))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, " ")
    )


def reject_reason(text: Column) -> Column:
    """Why a text is not accepted; null for a valid one."""
    length = F.char_length(text)
    return (
        F.when(text.isNull(), "missing")
        .when(length < MIN_TEXT_CHARS, "empty")
        .when(length > MAX_TEXT_CHARS, "too_long")
        .when(F.regexp_replace(text, f"{WHITE_SPACE}+", "") == "", "blank")
    )


def strip_tag_prefix(tag: Column) -> Column:
    return F.regexp_replace(tag, "^(B|I)-", "")


def _coded(words: Column, vocabulary: Column) -> Column:
    digits = F.transform(
        words,
        lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + _FIRST_WORD_CODE), 8, "0"),
    )
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-32")


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance of two whitespace-separated texts, without a UDF."""
    pair = F.struct(split_words(reference).alias("r"), split_words(hypothesis).alias("h"))
    return let(
        pair,
        lambda p: let(
            F.array_union(p["r"], p["h"]),
            lambda v: F.when(
                F.size(v) <= _MAX_WORDS, F.levenshtein(_coded(p["r"], v), _coded(p["h"], v))
            ).otherwise(F.raise_error(F.lit("too many distinct words in one pair")).cast("int")),
        ),
    )


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edits per reference word; null where the reference has no words."""
    words = F.size(split_words(reference))
    return F.when(words > 0, word_edits(reference, hypothesis) / words)


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character edits per reference character, spaces included."""
    chars = F.char_length(reference)
    return F.when(chars > 0, F.levenshtein(reference, hypothesis) / chars)
