"""Feature engineering: scaling, encoding, text n-grams, feature ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import scalars
from brindle.functions import semantics as S
from brindle.sources import scratch

METHODS = ("minmax", "zscore", "logscale", "binning")


def _numeric(df: DataFrame, columns: list[str] | None) -> list[T.StructField]:
    if columns:
        return [f for c in columns if (f := S.field(df, c)) is not None]
    return [f for f in df.schema.fields if S.logical(f) == "Numeric"]


def normalize(df: DataFrame, columns: list[str] | None = None, method: str = "minmax", bins: int = 10) -> DataFrame:
    """Scale columns' numbers; other cells stay as they are. Statistics are one aggregate, joined as a single row."""
    if method not in METHODS:
        raise ValueError(f"Unknown scaling '{method}'.")
    fields = _numeric(df, columns)
    stats: list[Column] = []
    for i, f in enumerate(fields):
        n = S.to_number(f)
        stats += [F.min(n).alias(f"_low{i}"), F.max(n).alias(f"_high{i}"), F.avg(n).alias(f"_mean{i}"), F.stddev_samp(n).alias(f"_sd{i}")]
    needed = {"minmax": ("_low", "_high"), "binning": ("_low", "_high"), "zscore": ("_mean", "_sd"), "logscale": ()}[method]
    stats = [s for s, name in zip(stats, [p + str(i) for i in range(len(fields)) for p in ("_low", "_high", "_mean", "_sd")]) if name.rstrip("0123456789") in needed]
    wide = df.crossJoin(F.broadcast(df.agg(*stats))) if stats else df
    done = {}
    for i, f in enumerate(fields):
        v = S.to_number(f)
        low, high, mean, sd = (F.col(f"{p}{i}") for p in ("_low", "_high", "_mean", "_sd"))
        if method == "minmax":
            scaled = F.when(high - low < 1e-12, 0.0).otherwise(F.try_divide(v - low, high - low))
        elif method == "zscore":
            scaled = F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise(F.try_divide(v - mean, sd))
        elif method == "logscale":
            scaled = F.ln(F.greatest(v, F.lit(1e-9)) + 1)
        else:
            width = (high - low) / F.lit(float(bins))
            scaled = F.when(high - low < 1e-12, 0.0).otherwise(F.least(F.lit(float(bins - 1)), F.try_divide(v - low, width).cast("int").cast("double")))
        scaled = F.when(v.isNotNull(), scaled)
        if isinstance(f.dataType, T.StringType):
            # A text cell that is no number stays; numbers are rendered back into the text column.
            shown = S.render(T.StructField("_scaled", T.DoubleType()))
            wide = wide.withColumn("_scaled", scaled).withColumn(f"_done{i}", F.when(v.isNotNull(), shown).otherwise(S.col(f))).drop("_scaled")
            done[f.name] = F.col(f"_done{i}")
        else:
            done[f.name] = scaled
    return wide.select(*[done[f.name].alias(f.name, metadata=f.metadata or {}) if f.name in done else S.col(f) for f in df.schema.fields])


def dictionary(df: DataFrame, f: T.StructField, limit: int | None = None) -> list[str]:
    """Distinct rendered values without case, sorted without case; the display form is the smallest of its spellings."""
    shown = S.key(f)
    found = df.groupBy(F.lower(shown).alias("k")).agg(F.min(shown).alias("v")).orderBy("k")
    rows = (found.limit(limit + 1) if limit else found).collect()
    if limit and len(rows) > limit:
        raise ValueError(f"'{f.name}' has over {limit} distinct values; use hashing instead of one column per value.")
    return [r["v"] for r in rows]


def dense_ranks(values: DataFrame, column: str, rank: str) -> DataFrame:
    """Distinct values with their rank from 0, sorted in ranges; the ranges' sizes are one row a partition."""
    path = scratch.folder(values.sparkSession)
    values.repartitionByRange(column).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = values.sparkSession.read.parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return placed.select(column, (F.col("_before") + inside - 1).cast("double").alias(rank))


def one_hot(df: DataFrame, columns: list[str], method: str = "oneHot", hash_bits: int = 10) -> DataFrame:
    """Encode categories: a 0/1 column per value (at most 200), the rank in the sorted dictionary, or a hash bucket."""
    fields = [f for c in columns if (f := S.field(df, c)) is not None]
    if method == "hash":
        size = 1 << min(max(hash_bits, 4), 20)
        hashed = {f.name: F.pmod(F.xxhash64(F.lower(S.key(f))), F.lit(size)).cast("double").alias(f.name) for f in fields}
        return df.select(*[hashed.get(f.name, S.col(f)) for f in df.schema.fields])
    if method == "ordinal":
        out = df
        for i, f in enumerate(fields):
            out = out.join(dense_ranks(df.select(F.lower(S.key(f)).alias(f"_k{i}")).distinct(), f"_k{i}", f"_r{i}"), F.lower(S.key(f)) == F.col(f"_k{i}"), "left")
        ranked = {f.name: F.col(f"_r{i}").alias(f.name) for i, f in enumerate(fields)}
        return out.select(*[ranked.get(f.name, S.col(f)) for f in df.schema.fields])
    gone = {f.name for f in fields}
    out, taken = [S.col(f) for f in df.schema.fields if f.name not in gone], [f.name for f in df.schema.fields if f.name not in gone]
    for f in fields:
        for value in dictionary(df, f, 200):
            name = S.free_name(taken, f"{f.name}_{value}")
            taken.append(name)
            out.append((F.lower(S.key(f)) == F.lit(value.lower())).cast("double").alias(name))
    return df.select(*out)


def vocabulary(df: DataFrame, column: str, grams: int = 2, remove_stop_words: bool = True, char_gram_length: int = 0, limit: int = 512) -> DataFrame:
    """Terms that occur more than once, the ``limit`` most frequent, ties by term: ``(term, n, slot)``."""
    terms = _terms(F.col(column), grams, remove_stop_words, char_gram_length)
    counts = df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "term").limit(limit)
    return top.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1)  # at most ``limit`` rows


def _terms(c: Column, grams: int, remove_stop_words: bool, char_gram_length: int) -> Column:
    terms = scalars.word_grams(c, grams, remove_stop_words)
    return F.concat(terms, scalars.char_grams(c, char_gram_length)) if char_gram_length else terms


def featurize_text(df: DataFrame, column: str, output: str = "TextFeatures", grams: int = 2, remove_stop_words: bool = True, char_gram_length: int = 0, as_array: bool = False) -> DataFrame:
    """Counts of the vocabulary's terms in each text, as space-joined text or an array.

    The vocabulary (512 terms at most) is collected; each row then counts its own terms without a shuffle."""
    f = S.required(df, column)
    terms = [r["term"] for r in vocabulary(df, f.name, grams, remove_stop_words, char_gram_length).orderBy("slot").collect()]
    mine = _terms(S.col(f), grams, remove_stop_words, char_gram_length)
    name = S.free_name(df.columns, "_terms")
    slots = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    wide = df.withColumn(name, mine)
    counts = F.transform(slots, lambda t: F.size(F.filter(F.col(name), lambda x: x == t)))
    value = counts if as_array else F.array_join(counts.cast("array<string>"), " ")
    return wide.withColumn(S.free_name(df.columns, output), value).drop(name)


def feature_scores(df: DataFrame, label: str, method: str = "correlation", bins: int = 10) -> DataFrame:
    """``(feature, score)`` of each numeric column against the label; cells that are no numbers count as 0."""
    target = S.required(df, label)
    fields = [f for f in df.schema.fields if f.name != target.name and S.logical(f) == "Numeric"]
    if not fields:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    y = F.coalesce(S.to_number(target), F.lit(0.0))
    values = df.select(y.alias("y"), *[F.coalesce(S.to_number(f), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(fields)])
    if method == "mutualInformation":
        return _mutual_information(values, fields, bins)
    scores = []
    for i, f in enumerate(fields):
        x = F.col(f"x{i}")
        if method == "variance":
            score = F.coalesce(F.var_samp(x), F.lit(0.0))
        else:
            safe = (F.var_pop(x) >= 1e-12) & (F.var_pop("y") >= 1e-12)
            score = F.when(safe, F.abs(F.try_divide(F.covar_pop(x, F.col("y")), F.stddev_pop(x) * F.stddev_pop("y")))).otherwise(0.0)
        scores.append(F.struct(F.lit(f.name).alias("feature"), score.alias("score")))
    one = values.agg(F.array(*scores).alias("s"))
    return one.select(F.explode("s").alias("s")).select("s.feature", "s.score")


def _mutual_information(values: DataFrame, fields: list[T.StructField], bins: int) -> DataFrame:
    """From joint counts of at most bins * bins cells per feature; one shuffle of partial counts."""
    names = ["y", *[f"x{i}" for i in range(len(fields))]]
    ends = values.agg(*[F.min(n).alias(f"low_{n}") for n in names], *[F.max(n).alias(f"high_{n}") for n in names])
    from brindle.operators.profile import bin_number

    wide = values.crossJoin(F.broadcast(ends))
    placed = {n: bin_number(F.col(n), F.col(f"low_{n}"), F.col(f"high_{n}"), bins) for n in names}
    cells = F.array(*[F.struct(F.lit(f.name).alias("feature"), placed[f"x{i}"].alias("a"), placed["y"].alias("b")) for i, f in enumerate(fields)])
    joint = wide.select(F.explode(cells).alias("c")).groupBy("c.feature", "c.a", "c.b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    joint = joint.select("feature", "n", over().alias("all"), over("a").alias("na"), over("b").alias("nb"))
    part = F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))
    return joint.groupBy("feature").agg(F.sum(part).alias("score"))


def select_features(df: DataFrame, label: str, method: str = "correlation", top: int = 10) -> tuple[DataFrame, DataFrame]:
    """The label and the ``top`` best numeric columns, and all scores; other columns go. The scores are a driver decision."""
    scores = feature_scores(df, label, method)
    order = {f.name: i for i, f in enumerate(df.schema.fields)}
    ranked = sorted(scores.collect(), key=lambda r: (-(r["score"] if not math.isnan(r["score"]) else 0), order[r["feature"]]))
    kept = {r["feature"] for r in ranked[:top]} | {S.required(df, label).name}
    return df.select(*[S.col(f) for f in df.schema.fields if f.name in kept]), scores
