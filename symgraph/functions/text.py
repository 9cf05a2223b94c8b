"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a question's terms leave out.
STOP_WORDS = (
    "a an and are as at be by can do does for from how i in is it its of on or the this to what when where which who why with work works working code file files "
    "function functions method methods class classes find show me get use used using into there that these those my our we you"
).split()
#: Parts of an identifier, and paths of tests.
PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$"


def occurrences(text: str | Column, part: str | Column) -> Column:
    """Non-overlapping occurrences of part in text."""
    text, part = (F.col(x) if isinstance(x, str) else x for x in (text, part))
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def stem(w: Column) -> Column:
    """A word without its first fitting ending: ing, ies (then y), es, ed, s, where more than three letters stay."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    out = w
    for ending, put in reversed((("ing", ""), ("ies", "y"), ("es", ""), ("ed", ""), ("s", ""))):
        k = len(ending)
        out = F.when(w.endswith(ending) & (n > k + 3), F.concat(cut(k), F.lit(put)) if put else cut(k)).otherwise(out)
    return out


def all_terms(text: str | Column) -> Column:
    """Stemmed terms of a text in order, without stop words and single letters. Identifiers are cut at case changes and digits; stop words go after stemming."""
    parts = F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.transform(parts, lambda w: stem(F.lower(w))), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def terms(text: str | Column) -> Column:
    """Distinct terms in order of first occurrence."""
    return F.array_distinct(all_terms(text))


def is_test_path(path: str | Column) -> Column:
    return F.col(path).rlike(TEST_PATH) if isinstance(path, str) else path.rlike(TEST_PATH)


def first_line_or_signature(limit: int = 200) -> Column:
    """A definition's meaning in one line: the first line of its summary, else its signature, cut at limit."""
    summary = F.trim(F.coalesce("summary", F.lit("")))
    flat = F.trim(F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", " "))
    cut = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)
    return F.when(summary != "", F.trim(F.substring_index(summary, "\n", 1))).otherwise(cut)


def utf16_units(text: str) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


@F.pandas_udf(T.StringType())
def _slug(names: pd.Series) -> pd.Series:
    plain = names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())
    return plain.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-")


def slug(name: str | Column) -> Column:
    """Lower-case ASCII with dashes; Spark has no compatibility decomposition, so this one is a vectorised UDF."""
    return _slug(name)


def register_functions(spark: SparkSession) -> None:
    """SQL names of the text functions."""
    spark.udf.register("slug_ascii", _slug)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    stemmed = "CASE " + " ".join(f"WHEN endswith(w, '{e}') AND length(w) > {len(e) + 3} THEN concat(substring(w, 1, length(w) - {len(e)}), '{put}')" for e, put in (("ing", ""), ("ies", "y"), ("es", ""), ("ed", ""), ("s", ""))) + " ELSE w END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION stem_word(w STRING) RETURNS STRING RETURN {stemmed}")
    each = stemmed.replace("(w", "(lower(w)").replace("ELSE w", "ELSE lower(w)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize_text(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(filter(transform(regexp_extract_all(t, '{PARTS}', 0), w -> {each}), w -> length(w) > 1 AND NOT array_contains(array({stop}), w)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION occurrences(t STRING, p STRING) RETURNS BIGINT RETURN CAST((length(t) - length(replace(t, p, ''))) / length(p) AS BIGINT)")
