"""Column functions over text: graphemes, case, words and sentences, request flags, codes of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.config import SOS

#: Letters and apostrophes in a row; SQL engines can express it too.
WORD_PATTERN = r"[\p{L}']+"


def graphemes(text: Column) -> Column:
    """User-perceived characters of a text; combining marks and joined emoji stay with their base. Empty gives none."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def trimmed(text: Column) -> Column:
    """Without white space (any script's) at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def split_at(text: Column, delimiter: str, most: int = -1) -> Column:
    """Pieces between ``delimiter``, taken literally; at most ``most`` cuts where that isn't negative."""
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(text, quoted, most + 1 if most >= 0 else -1)


def starts_with(parts: Column, head: Column) -> Column:
    """Whether an array begins with another; every array begins with the empty one."""
    return (F.size(head) == 0) | ((F.size(parts) >= F.size(head)) & (F.slice(parts, 1, F.greatest(F.size(head), F.lit(1))) == head))


def opposite_case(sign: Column) -> Column:
    """Upper case of a sign that has one, else its lower case."""
    return F.when(sign != F.upper(sign), F.upper(sign)).otherwise(F.lower(sign))


def equal_ignoring_case(a: Column, b: Column) -> Column:
    """Arrays of signs where each of ``a`` is the lower or upper form of its partner in ``b``."""
    same = F.zip_with(a, b, lambda x, y: (y == F.lower(x)) | (y == F.upper(x)))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda x: x)


def titlecase(text: Column | str) -> Column:
    """The first letter of every word in title case, the rest in lower case; words end at anything but letters, digits,
    marks and inner apostrophes. Nulls stay null."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[^\p{L}\p{N}\p{M}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, F.initcap), "")


def is_special(token: Column) -> Column:
    """Single characters below the blank are special tokens."""
    return (F.length(token) == 1) & (F.ascii(token) < 32)


def special_to_id(token: Column) -> Column:
    return F.when(is_special(token), -F.ascii(token))


def id_to_special(number: Column) -> Column:
    return F.when(number.between(-31, -1), F.char((-number).cast("bigint")))


def flag(flags: Column, shift: int, bits: int) -> Column:
    return F.shiftright(flags, shift).bitwiseAND(F.lit((1 << bits) - 1))


def decode_flags(flags: Column) -> Column:
    """A request's packed flags as a struct."""
    return F.struct(
        flag(flags, 0, 8).alias("max_count"),
        flag(flags, 8, 4).alias("ngram_level"),
        flag(flags, 12, 2).alias("start_shift"),
        flag(flags, 14, 2).alias("cursor_shift"),
        (flag(flags, 16, 1) == 1).alias("allow_offensive"),
        (flag(flags, 17, 1) == 1).alias("show_hidden"),
        (flag(flags, 18, 1) == 1).alias("is_private"),
    )


def case_mapped(text: Column, start_shift: Column, cursor_shift: Column) -> Column:
    """Results as the shift keys ask for: caps lock at the cursor gives capitals, any shift at the word's start a title."""
    return F.when(cursor_shift == 3, F.upper(text)).when(start_shift != 0, titlecase(text)).otherwise(text)


def in_proximity(near: Column, dictionary_sign: Column, typed: Column) -> Column:
    """Whether the typed sign is a neighbour of the dictionary's; a sign without neighbours has none."""
    return F.coalesce(F.array_contains(F.element_at(near, dictionary_sign), typed), F.lit(False))


def find_or(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(mapping, key), default)


def segment_sentences(text: Column) -> Column:
    """Sentences as arrays of words, by the JVM's text boundaries; punctuation is left out."""
    return F.sentences(text)


def segment_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def without_pos(token: Column) -> Column:
    """A unigram without what stands behind its last underscore."""
    return F.regexp_replace(token, "_[^_]*$", "")


def links(page: Column, pattern: str = r"<li><a href=\"([^\"]+)\">") -> Column:
    """Targets of a page's list of links."""
    return F.regexp_extract_all(page, F.lit(pattern), F.lit(1))


def padded_context(previous: Column, size: int) -> Column:
    """The last ``size`` words before the current one, start tokens in front where there are fewer."""
    if size < 1:
        return F.array().cast("array<string>")
    whole = F.concat(F.array_repeat(F.lit(SOS), size), F.coalesce(previous, F.array().cast("array<string>")))
    return F.slice(whole, -size, size)


SUGGESTION = "text STRING, secondaryText STRING, confidence DOUBLE, isEligibleForAutoCommit BOOLEAN, isEligibleForUserRemoval BOOLEAN"


def suggestion_to_json(text: Column, secondary: Column, confidence: Column, auto_commit: Column, removal: Column) -> Column:
    """A suggestion as JSON, under the published names; null values have no key."""
    names = [x.split()[0] for x in SUGGESTION.split(", ")]
    return F.to_json(F.struct(*(c.alias(n) for c, n in zip((text, secondary, confidence, auto_commit, removal), names))))


def suggestion_from_json(source: Column) -> Column:
    """A suggestion's struct of its JSON; absent keys are null, what isn't JSON gives nulls."""
    return F.from_json(source, SUGGESTION)


def shift_label(state: Column) -> Column:
    """Two letters for a shift state."""
    # Unshifted, manual and automatic shift, caps lock.
    return F.coalesce(F.get(F.array(*map(F.lit, ("US", "SM", "SA", "CL"))), state), F.lit("??"))


# Bits of a spelling result.
IN_DICTIONARY, TYPO, RECOMMENDED, GRAMMAR, NO_UI = 1, 2, 4, 8, 16


def spelling_label(bits: Column) -> Column:
    """A word for the state of a spelling result."""
    return F.when(bits.bitwiseAND(F.lit(IN_DICTIONARY)) != 0, "valid").when(bits.bitwiseAND(F.lit(TYPO)) != 0, "typo").when(bits.bitwiseAND(F.lit(GRAMMAR)) != 0, "grammar").otherwise("unspecified")
