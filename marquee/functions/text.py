"""Text column expressions (JVM-side, codegen'd; no Python UDFs).

The request and title rules are defined with Python's Unicode notion of
word, digit and space characters. Java's ``\\w``/``\\s`` are ASCII by
default, so the classes are spelled out with Unicode properties; the same
patterns run unchanged in RE2 (DuckDB) for the SQL oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Genre vocabulary recognised in request text, lower case, sorted.
GENRE_VOCAB = (
    "action", "adventure", "animation", "comedy", "crime", "drama", "fantasy",
    "horror", "mystery", "romance", "sci-fi", "thriller", "war", "western",
)
# Characters Python's str.isspace() accepts (its \s and strip() set).
SPACE_CHARS = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# A four-digit year in parentheses, e.g. "(1999)"; any Unicode decimal digit.
YEAR_PATTERN = r"\(\p{Nd}{4}\)"
# Anything that is neither a word character (letter, number, underscore)
# nor a space character.
PUNCT_PATTERN = r"[^\p{L}\p{N}_" + SPACE_CHARS + "]"
# Separator inside the genres string ("Action|Comedy").
GENRE_SEPARATOR = "[|]"
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def space_characters() -> str:
    """The characters of ``SPACE_CHARS``, spelled out."""
    found = re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?|\\([tnfr])|(.)", SPACE_CHARS)
    out = []
    for low, high, escape, plain in found:
        first = int(low, 16) if low else ord({"t": "\t", "n": "\n", "f": "\f", "r": "\r"}.get(escape, plain))
        out += [chr(c) for c in range(first, (int(high, 16) if high else first) + 1)]
    return "".join(out)


def strip_text(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode spaces. A trim
    reads a text once; a regular expression would retry at every inner space."""
    return F.btrim(_col(c), F.lit(space_characters()))


def normalize_title(c) -> Column:
    """Drop every ``(dddd)``, drop non-word non-space chars, lower, strip."""
    no_year = F.regexp_replace(_col(c), YEAR_PATTERN, "")
    no_punct = F.regexp_replace(no_year, PUNCT_PATTERN, "")
    return strip_text(F.lower(no_punct))


def split_genres(c) -> Column:
    """``'A|B'`` → ``['A', 'B']`` (a bare ``|`` would be regex alternation)."""
    return F.split(_col(c), GENRE_SEPARATOR, -1)


def vocab_array(vocab=GENRE_VOCAB) -> Column:
    return F.array(*[F.lit(g) for g in sorted(vocab)])


def extract_genres(c, vocab=GENRE_VOCAB) -> Column:
    """Vocabulary words that occur as substrings of the lowered text, sorted.

    Substring semantics are deliberate ("award" contains "war"). A null text
    gives an empty array.
    """
    lowered = F.lower(_col(c))
    return F.array_compact(F.array(*[F.when(lowered.contains(g), F.lit(g)) for g in sorted(vocab)]))


def requested_genres(seed_genres, text_genres) -> Column:
    """Set union of the seed's genre tokens and the text's vocabulary hits.

    Matching downstream is case-insensitive, so the set is kept lower-cased,
    distinct and sorted (the reference's set order is arbitrary).
    """
    seed_tokens = F.when(_col(seed_genres).isNull(), F.array().cast("array<string>")) \
        .otherwise(F.transform(split_genres(seed_genres), lambda t: F.lower(t)))
    return F.array_sort(F.array_distinct(F.concat(seed_tokens, _col(text_genres))))


def text_state(c) -> Column:
    """'missing' (null or empty), 'blank' (spaces only) or 'ok'."""
    t = _col(c)
    return (F.when(t.isNull() | (t == ""), F.lit("missing"))
            .when(strip_text(t) == "", F.lit("blank"))
            .otherwise(F.lit("ok")))
