"""Tokens, identifiers, predicates on query text, and result texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metadata under this prefix is the engine's own and is not searched.
OWN_PREFIX = "_millrace_"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.filter(F.split(ascii_lower(text), "[^A-Za-z0-9]+"), lambda t: t != "")


def unicode_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased: the terms of full-text ranking."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def identifiers(record_id: Column, title: Column, content: Column, metadata: Column, relations: Column) -> Column:
    """ASCII tokens of id, title, content, searched metadata keys and values, and relations."""
    searched = F.map_filter(metadata, lambda k, _: ~k.startswith(OWN_PREFIX))
    parts = F.concat(F.array(record_id, title, content), F.map_keys(searched), F.map_values(searched), relations)
    return F.flatten(F.transform(parts, ascii_tokens))


def is_quoted(text: Column) -> Column:
    """First and last character are quotes, and they are two."""
    trimmed = F.trim(text)
    return (F.char_length(trimmed) >= 2) & trimmed.startswith('"') & trimmed.endswith('"')


def exact_term(text: Column) -> Column:
    """The one term that an unquoted query looks up."""
    return ascii_lower(F.trim(text))


def contains_folded(text: Column, query: Column) -> Column:
    """Substring test in Unicode lower case."""
    return F.contains(F.lower(text), F.lower(query))


def finite(score: Column) -> Column:
    """NaN and infinities count as 0."""
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def excerpt(text: Column) -> Column:
    """Text with each run of white space as one space."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def match_percent(score: Column, first: Column) -> Column:
    """A score against the first hit's, 0 to 100."""
    share = F.greatest(score, F.lit(0.0)) / first * 100
    return F.when(first > 0, F.least(F.greatest(F.round(share), F.lit(0.0)), F.lit(100.0))).otherwise(0.0).cast("int")


def classify_path(path: Column) -> Column:
    """What a path may hold: code maps before Markdown, as their suffix ends in Markdown's."""
    return (
        F.when(path.endswith(".cfmap.md"), "CodeMap")
        .when(path.endswith(".md"), "Markdown")
        .when(path.endswith(".tsv"), "Registry")
        .when(path.endswith(".rs") | path.endswith(".py"), "CodeCandidate")
        .otherwise("Unsupported")
    )
