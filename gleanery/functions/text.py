"""Word expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode-aware: without (?U) a word with an accented letter is dropped whole.
WORD = r"(?U)\b\w+\b"
WORD_2PLUS = r"(?U)\b\w\w+\b"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def words_2plus(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_2PLUS), F.lit(0))


def unigrams_and_bigrams(c: Column) -> Column:
    def grams(tokens: Column) -> Column:
        pairs = F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))

    # A name inside a lambda stands for a value: the words are looked for once.
    return F.transform(F.array(words_2plus(c)), grams)[0]


def counted(items: Column) -> Column:
    """(gram, n) per different element of an array of strings: runs of the sorted array."""
    def runs(s: Column, ends: Column) -> Column:
        return F.transform(ends, lambda at, k: F.struct(F.get(s, at).alias("gram"), (at - F.coalesce(F.get(ends, k - 1), F.lit(-1))).alias("n")))

    def of_sorted(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda at: (at == F.size(s) - 1) | (F.get(s, at) != F.get(s, at + 1)))
        ends = F.when(F.size(s) > 0, ends).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array(ends), lambda e: runs(s, e))[0]

    return F.transform(F.array(F.sort_array(items)), of_sorted)[0]


def joined_text(names: list[str]) -> Column:
    """Blank-joined text of several columns; NULL parts are skipped."""
    return F.concat_ws(" ", *[F.col(n).cast("string") for n in names])


def first_filled(names: list[str]) -> Column:
    """First non-empty value, else the empty string."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names], F.lit(""))
