"""Text expressions: tokens, sentences, overlaps, guards, citations and templates. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions.timeparts import col

# Phrase lists that decide results.
REFUSALS = ("i cannot", "i'm unable", "as an ai", "i don't have", "i am unable", "i apologize", "i cannot provide")
CAUTIONS = (
    "limited evidence", "insufficient data", "uncertain", "not enough", "caution", "may not", "could not", "unreliable", "low confidence",
    "exercise caution", "interpret carefully", "should be treated", "results may vary", "data is sparse", "weak coverage",
)


def clean_text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-case words between white space; [] for null or blank."""
    return F.filter(F.split(F.lower(clean_text(c)), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(clean_text(c), r"\s+"), lambda w: w != ""))


def sentences(c: Column | str, min_words: int = 0, min_chars: int = 0) -> Column:
    """Sentences that end in . ! or ?; those with fewer words or signs are left out."""
    parts = F.transform(F.split(F.trim(clean_text(c)), r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda s: (s != "") & (F.length(s) > min_chars) & (F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= min_words))


def overlap_share(a: Column, b: Column) -> Column:
    """|A and B| / max(|A|, 1) over distinct words of two arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))


def contains_any(text: Column | str, phrases: Sequence[str]) -> Column:
    low = F.lower(clean_text(text))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def matched_phrases(text: Column | str, phrases: Sequence[str]) -> Column:
    low = F.lower(clean_text(text))
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: low.contains(p))


def valid_summary(c: Column | str, least_words: int = 30, refusals: Sequence[str] = REFUSALS) -> Column:
    """Enough words and no refusal phrase; null and blank are invalid."""
    return (word_count(c) >= least_words) & ~contains_any(c, refusals)


def json_list(c: Column | str) -> Column:
    """A JSON array of strings; [] where it's null or can't be read."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def missing_terms(answer: Column | str, terms: Column) -> Column:
    low = F.lower(clean_text(answer))
    return F.filter(terms, lambda t: ~low.contains(F.lower(t)))


def present_terms(answer: Column | str, terms: Column) -> Column:
    low = F.lower(clean_text(answer))
    return F.filter(terms, lambda t: low.contains(F.lower(t)))


def citations(c: Column | str, letter: str = "E") -> Column:
    """Distinct tags like E1 in the order of their numbers."""
    numbers = F.regexp_extract_all(clean_text(c), F.lit(rf"\[{letter}(\d+)\]"), F.lit(1))
    ordered = F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))
    return F.transform(ordered, lambda n: F.concat(F.lit(letter), n.cast("string")))


def render(template: str, *values: Column) -> Column:
    """printf-style rendering; missing numbers read 0."""
    return F.format_string(template, *values)


def row_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object of strings, keys of null fields included."""
    return F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def json_field(c: Column | str, field: str) -> Column:
    return F.coalesce(F.get_json_object(col(c), f"$.{field}"), F.lit(""))


def header(parts: Sequence[Column]) -> Column:
    """Non-null parts joined by ' | '."""
    return F.concat_ws(" | ", F.array_compact(F.array(*parts)))


def section(c: Column | str, name: str, following: str | None) -> Column:
    """Text of a headed section of a structured answer, up to the next header or the end; null if there is none."""
    until = rf"(?={following}:)" if following else r"\z"
    return F.nullif(F.regexp_extract(clean_text(c), rf"(?is){name}:\s*(.*?)\s*{until}", 1), F.lit(""))


def reply_field(c: Column | str, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(clean_text(c), rf"(?im)^\s*{name}:(.*)$", 1)), F.lit(""))


def chunks(c: Column | str) -> Column:
    """Non-empty paragraphs."""
    return F.filter(F.transform(F.split(clean_text(c), "\n\n"), lambda x: F.trim(x)), lambda x: x != "")


def key_values(c: Column | str) -> Column:
    """MAP of 'key: value' lines."""
    lines = F.filter(F.split(clean_text(c), "\n"), lambda x: x.contains(": "))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ": ", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^.*?: ", "")).alias("value"))
    return F.map_from_entries(F.transform(lines, pair))
