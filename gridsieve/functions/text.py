"""Text normalisation and keyword rules as plain column expressions (map-only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Textual spellings of a missing value.
NULL_TOKENS = ("nan", "none", "null")
WHITESPACE = " \t\n\r\x0b\x0c"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_lower(c: str | Column) -> Column:
    """Trim all surrounding whitespace (not only blanks) and lower-case."""
    return F.lower(F.trim(_col(c).cast("string"), F.lit(WHITESPACE)))


def fold_nulls(c: str | Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Textual null tokens become NULL."""
    c = _col(c)
    return F.when(c.isin(*tokens), F.lit(None)).otherwise(c)


def normalise(c: str | Column) -> Column:
    return fold_nulls(strip_lower(c))


def contains_ci(c: str | Column, pattern: str) -> Column:
    """Case-insensitive substring test; NULL counts as no match."""
    return F.coalesce(F.contains(F.lower(_col(c)), F.lit(pattern.lower())), F.lit(False))


def any_keyword(c: str | Column, keywords: Sequence[str]) -> Column:
    """1 if the text contains any keyword, else 0 (also for NULL)."""
    text = F.coalesce(strip_lower(c), F.lit(""))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(text, F.lit(word))
    return hit.cast("int")


def first_keyword(c: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """Label of the first rule, in table order, whose pattern occurs in the text."""
    out = default
    for pattern, label in reversed([r for r in rules if r[0]]):
        out = F.when(F.contains(c, F.lit(pattern)), F.lit(label)).otherwise(out)
    return out


def keyword_group(
    c: str | Column,
    rules: Sequence[tuple[str, str]],
    empty_label: str = "none",
    unmatched_label: str = "unknown",
    empty_tokens: Sequence[str] = ("", *NULL_TOKENS),
) -> Column:
    """Null-aware first-substring classification."""
    text = F.coalesce(strip_lower(c), F.lit(""))
    return F.when(text.isin(*empty_tokens), F.lit(empty_label)).otherwise(
        first_keyword(text, rules, F.lit(unmatched_label))
    )


def joint_keyword(
    columns: Sequence[str | Column],
    rules: Sequence[tuple[str, str]],
    separators: Sequence[str] = ("/", "-", "composite", "hybrid"),
    separator_label: str = "composite",
    default: str = "none",
) -> Column:
    """First keyword over several concatenated texts, then a separator rule, then a default."""
    text = F.concat_ws(" ", *[F.coalesce(strip_lower(c), F.lit("")) for c in columns])
    by_separator = F.lit(False)
    for sep in separators:
        by_separator = by_separator | F.contains(text, F.lit(sep))
    fallback = F.when(by_separator, F.lit(separator_label)).otherwise(F.lit(default))
    return first_keyword(text, rules, fallback)


def longest_substring(c: str | Column, table: Sequence[tuple[str, object]], default: object = None) -> Column:
    """Value of the exactly equal key, else of the longest key contained in the text.

    Equal lengths resolve to the earlier table entry. The whole table becomes one CASE
    expression, so the lookup is map-only; see ``operators.lookup.longest_substring_join``
    for dictionaries that live in tables.
    """
    text = F.coalesce(strip_lower(c), F.lit(""))
    out = F.lit(default)
    ordered = sorted((row for row in table if row[0]), key=lambda row: -len(row[0]))
    for key, value in reversed(ordered):
        out = F.when(F.contains(text, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def map_lookup(c: str | Column, table: Mapping, default: object = None) -> Column:
    """Scalar map lookup with a default for misses and NULL."""
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*flat), _col(c)), F.lit(default))


def one_hot(c: str | Column, values: Sequence[str], prefix: str = "is_") -> list[Column]:
    """One 0/1 column per listed value."""
    flags = []
    for value in values:
        name = prefix + "".join(ch if ch.isalnum() else "_" for ch in value.lower()).strip("_")
        flags.append(F.coalesce((_col(c) == F.lit(value)).cast("int"), F.lit(0)).alias(name))
    return flags
