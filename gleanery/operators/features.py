"""Feature encoding: fitted once, replayed on any batch or stream."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import as_moment
from ..functions.hashing import bucket_of
from ..functions.types import categorical_columns, is_numeric, numeric_columns, quoted, to_long
from ..session import cut, spread
from .lookup import lookup_join

INTERNAL = ["is_anomaly"]
LOW_CARDINALITY = 15
MISSING = "<missing>"


# ---------------------------------------------------------------- dates

def datetime_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Year, month, day, weekday (Monday = 0) and weekend flag; the source column goes."""
    present = [c for c in columns if c in df.columns]
    kept = [quoted(c) for c in df.columns if c not in present]
    parts = []
    for c in present:
        t = as_moment(df, c)
        parts += [
            F.year(t).alias(f"{c}_year"), F.month(t).alias(f"{c}_month"), F.day(t).alias(f"{c}_day"),
            F.weekday(t).alias(f"{c}_dayofweek"),
            F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)).alias(f"{c}_is_weekend"),
        ]
    return df.select(*kept, *parts)


# ---------------------------------------------------------------- categories

def cardinality_split(df: DataFrame, target: str | None = None, threshold: int = LOW_CARDINALITY) -> DataFrame:
    """Distinct counts of the categorical columns and whether each is low or high."""
    names = [c for c in categorical_columns(df) if c != target]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint, cardinality string")
    row = df.agg(*[F.count_distinct(quoted(c)).alias(f"n_unique__{i}") for i, c in enumerate(names)])
    return to_long(row, names, {"n_unique": "bigint"}).withColumn(
        "cardinality", F.when(F.col("n_unique") <= threshold, "low").otherwise("high"))


def category_lists(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values of low-cardinality columns: at most ``LOW_CARDINALITY`` short lists come back."""
    if not columns:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(quoted(c).cast("string"))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: list(row[f"s{i}"]) for i, c in enumerate(columns)}


def one_hot_exprs(categories: dict[str, list[str]]) -> list[Column]:
    return [
        F.coalesce((quoted(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, values in categories.items() for v in values[1:]
    ]


def one_hot_drop_first(df: DataFrame, columns: list[str], categories: dict | None = None) -> DataFrame:
    """Dummies for the fitted values, the first left out; NULL and unseen values give zeros."""
    fitted = categories if categories is not None else category_lists(df, columns)
    return df.select(*[quoted(c) for c in df.columns if c not in columns], *one_hot_exprs(fitted))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among the non-NULL rows."""
    counts = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("total")).alias("frequency"))


def frequency_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    facts = cut(frequency_table(df, column))
    size = facts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    keyed = df.withColumn("category", quoted(column).cast("string"))
    joined = lookup_join(keyed, facts, "category", "n", ["frequency"], size["k"], size["n"])
    return joined.withColumn(out or f"{column}_freq", F.coalesce("frequency", F.lit(0.0))).drop("category", "frequency")


def _smoothed(n: Column, s: Column, ss: Column, gn: Column, gs: Column, gss: Column) -> Column:
    """Empirical-Bayes mean of a category: shrinks to the overall mean as the category gets small or noisy."""
    mean, overall = s / n, gs / gn
    within = F.greatest(ss / n - mean * mean, F.lit(0.0))
    between = F.greatest(gss / gn - overall * overall, F.lit(0.0))
    weight = F.when(between * n + within > 0, between * n / (between * n + within))
    return F.when(weight.isNull(), overall).otherwise(weight * mean + (1 - weight) * overall)


def class_values(df: DataFrame, target: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct target values as text. More than ``limit`` of them is an error, not a truncation."""
    rows = df.filter(quoted(target).isNotNull()).select(quoted(target).cast("string").alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{target} has more than {limit} classes")
    return sorted(r["v"] for r in rows)


def outcome_columns(df: DataFrame, target: str, classes: list[str] | None) -> dict[str, Column]:
    """The numeric outcomes to average: the value itself, a 0/1 outcome, or one indicator per class."""
    if classes is None:
        return {"": quoted(target).cast("double")}
    text = quoted(target).cast("string")
    if len(classes) == 2:
        return {"": (text == F.lit(classes[1])).cast("double")}
    return {f"_{v}": (text == F.lit(v)).cast("double") for v in classes}


def target_sums(df: DataFrame, column: str, outcomes: dict[str, Column], fold: Column, folds: int, binary: bool) -> DataFrame:
    """Per category, and per fold within its row: count, sum and sum of squares of each outcome.

    One shuffle by category, combined on the map side; every encoding derives from this table. A 0/1 outcome needs no
    squares.
    """
    category = F.coalesce(quoted(column).cast("string"), F.lit(MISSING))
    base = df.select(category.alias("category"), fold.alias("fold"), *[y.alias(f"y{i}") for i, y in enumerate(outcomes.values())])
    sums = []
    for f in range(folds):
        here = F.col("fold") == f
        sums.append(F.count_if(here).alias(f"n_{f}"))
        for i in range(len(outcomes)):
            y = F.when(here, F.col(f"y{i}"))
            sums.append(F.coalesce(F.sum(y), F.lit(0.0)).alias(f"s{i}_{f}"))
            if not binary:
                sums.append(F.coalesce(F.sum(y * y), F.lit(0.0)).alias(f"ss{i}_{f}"))
    return base.filter(F.col("y0").isNotNull()).groupBy("category").agg(*sums)


def encodings(df: DataFrame, column: str, target: str, classes: list[str] | None, fold: Column | None = None, folds: int = 1) -> tuple[DataFrame, int, int]:
    """(category, n, enc0, enc1, ..) with the table's length and the number of rows behind it.

    Each ``enc`` holds one value per fold, taken from all other folds' rows, or a single value from all rows when there
    is one fold. The overall sums, a few numbers, come to the driver and go back as literals.
    """
    outcomes, binary = outcome_columns(df, target, classes), classes is not None
    sums = cut(target_sums(df, column, outcomes, F.lit(0) if fold is None else fold, folds, binary))
    names = [c for c in sums.columns if c != "category"]
    row = sums.agg(F.count(F.lit(1)).alias("_k"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    total = {c: float(row[c]) for c in names}

    def whole(prefix: str, skip: int | None) -> tuple[Column, float]:
        used = [f for f in range(folds) if f != skip]
        cells = [F.col(f"{prefix}_{f}") for f in used]
        return sum(cells[1:], cells[0]), sum(total[f"{prefix}_{f}"] for f in used)

    def value(i: int, skip: int | None) -> Column:
        n, gn = whole("n", skip)
        s, gs = whole(f"s{i}", skip)
        ss, gss = (s, gs) if binary else whole(f"ss{i}", skip)
        overall = F.lit(gs / gn if gn else 0.0)
        inside = _smoothed(n, s, ss, F.lit(gn), F.lit(gs), F.lit(gss))
        return F.when(n > 0, inside).otherwise(overall)

    skips = [None] if folds == 1 else list(range(folds))
    n_all, _ = whole("n", None)
    out = sums.select("category", n_all.alias("n"), *[F.array(*[value(i, f) for f in skips]).alias(f"enc{i}") for i in range(len(outcomes))])
    return out, row["_k"], int(sum(total[f"n_{f}"] for f in range(folds)))


def target_encodings(df: DataFrame, column: str, target: str, classes: list[str] | None) -> DataFrame:
    """Full-data encodings per category, one column per outcome."""
    table, _, _ = encodings(df, column, target, classes)
    return table.select("category", "n", *[F.col(f"enc{i}")[0].alias(f"encoding{suffix}") for i, suffix in enumerate(outcome_columns(df, target, classes))])


def target_encode_oof(df: DataFrame, column: str, target: str, classes: list[str] | None, keys: list[str], folds: int = 5) -> DataFrame:
    """Add cross-fitted encodings: a row is never encoded with its own fold's outcomes."""
    df = spread(df)
    suffixes = list(outcome_columns(df, target, classes))
    table, n_facts, total = encodings(df, column, target, classes, bucket_of(keys, folds), folds)
    keyed = df.withColumn("category", F.coalesce(quoted(column).cast("string"), F.lit(MISSING))).withColumn("_fold", bucket_of(keys, folds))
    joined = lookup_join(keyed, table, "category", "n", [f"enc{i}" for i in range(len(suffixes))], n_facts, total)
    return joined.select(*[quoted(c) for c in df.columns], *[F.get(F.col(f"enc{i}"), F.col("_fold")).alias(f"{column}_te{suffix}") for i, suffix in enumerate(suffixes)])


# ---------------------------------------------------------------- labels and scale

def label_classes(df: DataFrame, target: str, limit: int = 10_000) -> list[str]:
    """Stringified classes in text order. More than ``limit`` classes is an error, not a truncation."""
    return class_values(df, target, limit)


def label_encode(target: str, classes: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), quoted(target).cast("string")) - 1).cast("double")


def label_decode(index: Column, classes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)


def scale_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column from one aggregation; a zero deviation divides by one."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(quoted(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"] if row[f"m{i}"] is not None else 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(name: str, stats: tuple[float, float]) -> Column:
    return (quoted(name).cast("double") - F.lit(float(stats[0]))) / F.lit(float(stats[1]))


def standard_scale(df: DataFrame, exclude: list[str] | None = None, stats: dict | None = None) -> DataFrame:
    columns = [c for c in numeric_columns(df) if c not in (exclude or [])]
    fitted = stats if stats is not None else scale_statistics(df, columns)
    return df.select([scaled(c, fitted[c]).alias(c) if c in fitted else quoted(c) for c in df.columns])


def reindex_features(df: DataFrame, feature_columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly the wanted columns in order: absent ones are 0, others go."""
    return df.select(*[quoted(c) for c in (keep or [])],
                     *[quoted(c) if c in df.columns else F.lit(0).alias(c) for c in feature_columns])


# ---------------------------------------------------------------- the whole chain

@dataclass
class Preprocessor:
    """Dates, categories and scaling, fitted once; ``transform`` is column expressions and static joins only."""

    target: str | None = None
    datetime_cols: list[str] = field(default_factory=list)
    categories: dict[str, list[str]] = field(default_factory=dict)
    high_card: list[str] = field(default_factory=list)
    encoding: str = "none"
    suffixes: list[str] = field(default_factory=list)
    overall: dict[str, list[float]] = field(default_factory=dict)
    sizes: dict[str, list[int]] = field(default_factory=dict)
    scale: dict[str, list[float]] = field(default_factory=dict)
    feature_columns: list[str] = field(default_factory=list)
    raw_input_columns: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._facts: dict[str, DataFrame] = {}

    # -- fit

    def fit_transform(self, df: DataFrame, target: str | None = None, datetime_cols: list[str] | None = None,
                      exclude: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
        """Fit on ``df`` and return its features, high-cardinality columns encoded out of fold.

        ``keys`` identify a row for the folds. The target, ``is_anomaly`` and the ``exclude`` columns pass through.
        """
        keys = keys or [c for c in df.columns if c != target]
        out_of_play = set(INTERNAL) | set(exclude or [])
        self.target = target
        self.datetime_cols = [c for c in (datetime_cols or []) if c and c != target]
        self.raw_input_columns = [c for c in df.columns if c != target and c not in out_of_play]
        self.keep = [c for c in [target, *INTERNAL, *(exclude or [])] if c and c in df.columns]
        # Taken before any column changes, so a row's fold stays the same throughout.
        df = df.withColumn("_fold_key", F.concat_ws("|", *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in keys]))
        keys = ["_fold_key"]
        self.keep = [*self.keep, "_fold_key"]
        df = datetime_features(df, self.datetime_cols)

        inputs = df.select([quoted(c) for c in df.columns if c not in self.keep])
        split = cardinality_split(inputs).collect()
        low = [r["column"] for r in split if r["cardinality"] == "low"]
        self.high_card = [r["column"] for r in split if r["cardinality"] == "high"]
        self.categories = category_lists(df, low)
        encoded = self._fit_high_card(df, keys)

        wide = encoded.select(*[quoted(c) for c in encoded.columns if c not in low], *one_hot_exprs(self.categories))
        dummies = {f"{c}_{v}" for c, values in self.categories.items() for v in values[1:]}
        scale_cols = [c for c in numeric_columns(wide) if c not in dummies and c not in self.keep]
        self.scale = {c: list(s) for c, s in scale_statistics(wide, scale_cols).items()}
        self.feature_columns = [c for c in wide.columns if c not in self.keep]
        self.keep = [c for c in self.keep if c != "_fold_key"]
        return self._finish(wide)

    def fit(self, df: DataFrame, **kwargs) -> "Preprocessor":
        self.fit_transform(df, **kwargs)
        return self

    def _fit_high_card(self, df: DataFrame, keys: list[str]) -> DataFrame:
        if not self.high_card:
            return df
        classes, use_target = None, False
        if self.target and self.target in df.columns:
            facts = df.agg(F.count_distinct(quoted(self.target)).alias("k"), F.count(F.lit(1)).alias("n")).first()
            use_target = facts["k"] <= 50 and facts["k"] < 0.5 * facts["n"]
            if use_target:
                kind = df.schema[self.target].dataType
                whole = not is_numeric(kind) or df.agg(F.bool_and(quoted(self.target) == F.round(quoted(self.target))).alias("w")).first()["w"]
                classes = class_values(df, self.target) if whole else None
        self.encoding = "target" if use_target else "frequency"
        out = df
        for c in self.high_card:
            if use_target:
                outcomes = outcome_columns(df, self.target, classes)
                self.suffixes = list(outcomes)
                table = cut(target_encodings(df, c, self.target, classes))
                total = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
                means = df.agg(*[F.avg(y).alias(f"m{i}") for i, y in enumerate(outcomes.values())]).first()
                self.overall[c] = [means[f"m{i}"] for i in range(len(outcomes))]
                out = target_encode_oof(out, c, self.target, classes, keys)
                out = out.select(*[quoted(x) for x in out.columns if x != c and not x.startswith(f"{c}_te")],
                                 *[F.col(f"{c}_te{s}").alias(f"{c}{s}") for s in self.suffixes])
            else:
                self.suffixes = [""]
                table = cut(frequency_table(df, c).select("category", "n", F.col("frequency").alias("encoding")))
                total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
                self.overall[c] = [0.0]
            self._facts[c] = table
            self.sizes[c] = [total["k"], total["n"]]
            if not use_target:
                out = self._encode(out, c)
        return out

    # -- replay

    def _encode(self, df: DataFrame, c: str) -> DataFrame:
        values = [f"encoding{s}" for s in self.suffixes]
        key = quoted(c).cast("string")
        if self.encoding == "target":
            key = F.coalesce(key, F.lit(MISSING))
        keyed = df.withColumn("category", key)
        joined = lookup_join(keyed, self._facts[c], "category", "n", values, *self.sizes[c])
        return joined.select(
            *[quoted(x) for x in df.columns if x != c],
            *[F.coalesce(F.col(v), F.lit(m)).alias(f"{c}{s}") for v, s, m in zip(values, self.suffixes, self.overall[c])])

    def _finish(self, wide: DataFrame) -> DataFrame:
        """Scale, and put 0 (the mean) where a date part or number is missing."""
        return wide.select(
            *[quoted(c) for c in wide.columns if c in self.keep],
            *[F.coalesce(scaled(c, self.scale[c]) if c in self.scale else quoted(c).cast("double"), F.lit(0.0)).alias(c)
              for c in self.feature_columns])

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Replay on new rows. ``keep`` names columns to pass through next to the features."""
        missing = [c for c in self.raw_input_columns if c not in df.columns]
        if missing:
            raise ValueError(f"Missing columns: {missing}. Required: {self.raw_input_columns}")
        passed = [c for c in (keep or []) if c in df.columns]
        carried = df.select(*[quoted(c).alias(f"_keep_{c}") for c in passed], *[quoted(c) for c in self.raw_input_columns])
        out = datetime_features(carried, self.datetime_cols)
        for c in self.high_card:
            out = self._encode(out, c)
        out = out.select(*[quoted(c) for c in out.columns if c not in self.categories], *one_hot_exprs(self.categories))
        features = [F.coalesce(scaled(c, self.scale[c]) if c in self.scale else quoted(c).cast("double"), F.lit(0.0)).alias(c)
                    for c in self.feature_columns]
        return out.select(*[F.col(f"`_keep_{c}`").alias(c) for c in passed], *features)

    # -- persistence

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "fitted string").write.mode("overwrite").parquet(f"{path}/fitted")
        for i, c in enumerate(self.high_card):
            self._facts[c].write.mode("overwrite").parquet(f"{path}/lookup_{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        out = cls(**json.loads(spark.read.parquet(f"{path}/fitted").first()["fitted"]))
        out._facts = {c: spark.read.parquet(f"{path}/lookup_{i}") for i, c in enumerate(out.high_card)}
        return out
