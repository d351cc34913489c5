"""Quality rules: base rules, then robust outliers of each language and source by minimum covariance determinant.

Everything is DataFrame expressions; per-document statistics never leave the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .common import GAP, GAP_CHARS, UPPER, small

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Outliers:
    """``share`` of a group's rows form its core; ``steps`` concentration steps; a row is rejected when its robust squared distance
    exceeds ``cutoff`` and at least one statistic lies on the bad side. Statistics vary by at least ``floor``; groups
    below ``least`` rows are judged with the rest of their language, then with all such rows, then not at all."""

    share: float = 0.75
    steps: int = 4
    cutoff: float = 60.0
    least: int = 100


#: Name, least standard deviation.
FEATURES = {"symbols": 0.03, "duplicates": 0.12, "repeats": 0.12, "length": 0.08, "capitals": 0.05}
BINS = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text, the first occurrence included."""
    def pairs(hashes: Column, step: int) -> Column:
        n = F.greatest(F.size(hashes) - step, F.lit(0))
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))

    def covered(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = _let(ranked, lambda r: F.transform(r, lambda x, j: F.when(
            (F.get(r, j - 1)["h"] == x["h"]) | (F.get(r, j + 1)["h"] == x["h"]), x["i"])))
        places = F.array_sort(F.filter(again, lambda p: p.isNotNull()))
        return _let(places, lambda p: F.aggregate(
            F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, v: s + v))

    def count(eights: Column) -> Column:
        return F.when(F.size(F.array_distinct(eights)) == F.size(eights), F.lit(0)).otherwise(covered(eights))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    eights = _let(hashed, lambda h: _let(pairs(h, 1), lambda two: _let(pairs(two, 2), lambda four: pairs(four, 4))))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(eights, count)).cast("long")


def statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, GAP_CHARS, " " * len(GAP_CHARS))) != "")
    dup = _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n")))

    def chars_in(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")

    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).alias("repeats")))
    return _let(F.struct(counted.alias("w"), dup.alias("d")), lambda s: F.struct(
        s["w"]["n"].alias("n_words"), (F.length(text) - chars_in(GAP_CHARS)).cast("long").alias("word_chars"), chars_in(SYMBOLS).alias("n_symbols"),
        s["d"]["dup"].alias("n_dup_lines"), s["w"]["repeats"].alias("n_repeat_words"), s["d"]["n"].alias("n_lines"), chars_in(UPPER).alias("n_capitals")))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with lang, source, the counts of ``statistics`` and the vector ``x`` of transformed ones, as _q."""
    s = F.col("_q")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), statistics(F.col("text")).alias("_q"))

    def share(part: str, whole: str) -> Column:
        return F.sqrt(s[part] / F.greatest(s[whole], F.lit(1)))

    x = [share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
         F.log((s["word_chars"] + 1) / (s["n_words"] + 1)), share("n_capitals", "word_chars")]
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    return rows.withColumn("_x", F.array(*[v.cast("double") for v in x])).withColumn("_failed", failed)


def _grouped(rows: DataFrame, how: Outliers) -> DataFrame:
    """(lang, source, group): the rows a document is judged with; null languages and sources are values of their own."""
    pair = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    few = F.when(F.col("n") < how.least, F.col("n")).otherwise(F.lit(0))
    per_lang = F.sum(few).over(Window.partitionBy("_lang"))
    name = F.when(F.col("n") >= how.least, F.to_json(F.struct("_lang", "_source"))).when(per_lang >= how.least, F.to_json(F.struct("_lang"))).otherwise(F.lit("rest"))
    return small(pair.select("_lang", "_source", name.alias("_group")))


def _quantiles(rows: DataFrame, values: Column, at: float) -> DataFrame:
    """(group, j, v): per group and place the smallest bin edge with a share ``at`` of the rows below; only bin counts move."""
    bins = rows.select("_group", F.posexplode(F.transform(values, lambda v: F.floor(v * BINS).cast("long"))).alias("j", "bin"))
    counts = bins.groupBy("_group", "j", "bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("_group", "j").orderBy("bin")
    reached = counts.withColumn("below", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("_group", "j")))
    return reached.filter(F.col("below") >= at * F.col("all")).groupBy("_group", "j").agg(((F.min("bin") + 1) / F.lit(float(BINS))).alias("v"))


def _as_array(quantiles: DataFrame, name: str) -> DataFrame:
    return quantiles.groupBy("_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias(name))


def _moments(rows: DataFrame) -> DataFrame:
    """(group, n, mean, inverse): ``inverse`` is the inverse Cholesky factor of the floored covariance, by rows."""
    p, floors = len(FEATURES), list(FEATURES.values())
    x = [F.col("_x")[i] for i in range(p)]
    got = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in range(p)],
                                     *[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])
    for i in range(p):
        got = got.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + floors[i] ** 2)
    got = cut(got)
    # Lower factor, then its inverse, entry by entry.
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            got = got.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    got = cut(got)
    for i in range(p):
        got = got.withColumn(f"i{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in reversed(range(i)):
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"i{k}{j}")
            got = got.withColumn(f"i{i}{j}", rest / F.col(f"l{i}{i}"))
    return got.select("_group", F.col("n").alias("_n"), F.array(*[F.col(f"m{i}") for i in range(p)]).alias("_mean"),
                      F.array(*[F.col(f"i{i}{j}") for i in range(p) for j in range(i + 1)]).alias("_inverse"))


def _distance2(mean: str = "_mean", inverse: str = "_inverse") -> Column:
    total, at = F.lit(0.0), 0
    for i in range(len(FEATURES)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(inverse)[at] * (F.col("_x")[j] - F.col(mean)[j])
            at += 1
        total = total + z * z
    return total


#: Median of a chi-square variable with as many degrees as there are features.
CHI2_MEDIAN = 4.3515


def fit_outliers(rows: DataFrame, how: Outliers = Outliers()) -> DataFrame:
    """(lang, source, mean, inverse, scale, n) per language and source, from written rows of ``with_statistics``.

    The start is the median and the median deviation of each statistic; every step keeps the share of rows nearest to the
    centre and takes their mean and covariance. All rows count, and only sums and bin counts per group are shuffled.
    """
    groups = _grouped(rows, how)
    same = [F.col("r._lang").eqNullSafe(F.col("g._lang")), F.col("r._source").eqNullSafe(F.col("g._source"))]
    rows = rows.select("_lang", "_source", "_x").alias("r").join(groups.alias("g"), same).select("g._group", "r._x")
    centre = small(_as_array(_quantiles(rows, F.col("_x"), 0.5), "centre"))
    off = F.zip_with("_x", "centre", lambda a, b: F.abs(a - b))
    spread = small(_as_array(_quantiles(rows.join(centre, "_group"), off, 0.5), "spread"))
    floors = F.array(*[F.lit(f) for f in FEATURES.values()])
    wide = F.zip_with("spread", floors, lambda s, f: F.greatest(s * 1.4826, f))
    start = F.aggregate(F.zip_with(off, wide, lambda d, s: (d / s) * (d / s)), F.lit(0.0), lambda a, b: a + b)
    measured = rows.join(centre, "_group").join(spread, "_group").select("_group", "_x", start.alias("_d2"))
    params = None
    for _ in range(how.steps):
        # Distances are ranked on a log scale, whose bins are equally fine for near and far rows.
        far = F.log1p("_d2")
        edge = small(_quantiles(measured, F.array(far), how.share).select("_group", F.col("v").alias("edge")))
        core = measured.join(edge, "_group").filter(far <= F.col("edge"))
        params = small(_moments(core))
        measured = rows.join(params, "_group").select("_group", "_x", _distance2().alias("_d2"))
    median = small(_quantiles(measured, F.array(F.log1p("_d2")), 0.5).select("_group", F.greatest(F.expm1("v") / CHI2_MEDIAN, F.lit(1.0)).alias("_scale")))
    fitted = params.join(median, "_group")
    return small(groups.join(fitted, "_group").select("_lang", "_source", "_mean", "_inverse", "_scale", "_n", "_group"))


def with_verdict(rows: DataFrame, params: DataFrame, how: Outliers = Outliers()) -> DataFrame:
    """``rows`` of ``with_statistics`` with _distance and _kept."""
    same = F.col("r._lang").eqNullSafe(F.col("p._lang")) & F.col("r._source").eqNullSafe(F.col("p._source"))
    met = rows.alias("r").join(params.alias("p"), same, "left").select("r.*", "p._mean", "p._inverse", "p._scale", "p._n")
    # Fewer symbols, repeats or capitals than usual are no fault; word length is one either way.
    worse = F.exists(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), lambda j: F.get("_x", j) > F.get("_mean", j))
    outlier = (F.col("_distance") > how.cutoff) & (F.col("_n") >= how.least * how.share) & worse
    judged = met.withColumn("_distance", _distance2() / F.col("_scale"))
    return judged.withColumn("_kept", ~F.col("_failed") & ~F.coalesce(outlier, F.lit(False))).drop("_mean", "_inverse", "_scale", "_n")


def judge_quality(docs: DataFrame, how: Outliers = Outliers()) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the robust distance, one row for each input row.

    A null text counts as empty and fails the base rules. Null languages and sources form groups of their own; repeated rows
    each come back; an empty table gives an empty result; other columns are not read.
    """
    rows = cut(with_statistics(docs, "doc_id"))
    judged = with_verdict(rows, fit_outliers(rows, how), how)
    return judged.select("doc_id", *[F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_distance").alias("distance"))


def keep_good(docs: DataFrame, how: Outliers = Outliers()) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` alone, whatever their names.

    Null and empty texts fail the base rules; null languages and sources form groups of their own; repeated rows are judged alike and
    all come back or none; an empty table gives an empty result.
    """
    packed = docs.select(F.struct("*").alias("doc"), "lang", "source", "text")
    rows = cut(with_statistics(packed, "doc"))
    return with_verdict(rows, fit_outliers(rows, how), how).filter("_kept").select("doc.*")
