"""Valuation statistics: assessment ratios by state, error measures, feature scales, holdouts, and a forward pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plausible(sales: DataFrame, low: float = 0.1, high: float = 10.0, least: float = 5000.0) -> DataFrame:
    ratio = F.col("price") / F.col("assessed")
    return sales.where((F.col("price") >= least) & (F.col("assessed") > 0) & ratio.between(low, high))


#: Ranks are known to 1 / ACCURACY of a group's values from its sketch; twice that on both sides is looked at exactly.
ACCURACY = 10_000


def medians(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """(by, median): exact medians of groups of any size. A sketch gives bounds that hold each group's middle; values outside are only
    counted where they lie, so that no task gets more than the few distinct ones inside. Nulls are passed over; without any other
    value the median is null."""
    v = rows.select(*by, value.alias("value"))
    near = [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY]
    bounds = v.groupBy(*by).agg(F.percentile_approx("value", near, ACCURACY).alias("bounds"), F.count("value").alias("n"))
    b = bounds.select(*[F.col(c).alias(f"__{c}") for c in by], "bounds", "n")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    side = F.when(F.col("value") < F.col("bounds")[0], -1).when(F.col("value") > F.col("bounds")[1], 1).otherwise(0)
    placed = v.join(F.broadcast(b), same).select(*by, "n", side.alias("side"), "value")  # a row for each group
    counted = placed.groupBy(*by, "n", "side", F.when(F.col("side") == 0, F.col("value")).alias("value")).agg(F.count("value").alias("here"), F.count("*").alias("rows"))
    counted = counted.withColumn("here", F.when(F.col("side") == 0, F.col("here")).otherwise(F.col("rows")))
    upto = counted.withColumn("upto", F.sum("here").over(Window.partitionBy(*by).orderBy("side", "value")))
    # of n values the median is the mean of those with (n - 1) div 2 and n div 2 values before them
    at = lambda k: F.min(F.when((F.col("side") == 0) & (F.col("upto") > k), F.col("value")))
    first = F.floor((F.col("n") - 1) / 2)
    below = F.max(F.when((F.col("side") < 0) & (F.col("upto") > first), True))
    found = upto.groupBy(*by, "n").agg(at(first).alias("low"), at(F.floor(F.col("n") / 2)).alias("high"), below.alias("below"))
    lost = (F.col("n") > 0) & (F.col("below").isNotNull() | F.col("high").isNull())
    middle = F.when(lost, F.raise_error(F.lit("a sketch's bounds miss the median")).cast("double")).otherwise(F.col("low") + (F.col("high") - F.col("low")) / 2)
    return found.select(*by, middle.alias("median"))


def state_ratios(sales: DataFrame) -> DataFrame:
    """(state, ratio, pooled): exact median price over assessed value of each state and of all sales."""
    groups = F.array(F.struct("state", F.lit(False).alias("all")), F.struct(F.lit(None).alias("state"), F.lit(True).alias("all")))
    each = sales.select((F.col("price") / F.col("assessed")).alias("ratio"), F.explode(groups).alias("g")).select("g.*", "ratio")
    m = medians(each, ["all", "state"], F.col("ratio"))
    pooled = F.max(F.when(F.col("all"), F.col("median"))).over(Window.partitionBy(F.lit(0)))  # a row for each state
    return m.withColumn("pooled", pooled).where(~F.col("all")).select("state", F.col("median").alias("ratio"), "pooled")


def error_measures(predicted: DataFrame, within: float = 0.1) -> DataFrame:
    """(state, mdape, within_share) of (state, price, estimate)."""
    off = F.abs(F.col("estimate") - F.col("price")) / F.col("price")
    shares = predicted.groupBy("state").agg(F.avg((off <= within).cast("double")).alias("within_share"))
    m = medians(predicted, ["state"], off).select(F.col("state").alias("__state"), F.col("median").alias("mdape"))
    return shares.join(m, F.col("state").eqNullSafe(F.col("__state"))).select("state", "mdape", "within_share")


def feature_scales(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std) by population; a constant feature has scale 1."""
    stats = rows.agg(*[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mean").alias("mean"), F.when(F.col(f"{f}.std") == 0, 1.0).otherwise(F.col(f"{f}.std")).alias("std")) for f in features])
    return stats.select(F.explode(each).alias("s")).select("s.*")


def held_out(domain: Column, fold: int) -> Column:
    """Whether a domain is in the holdout: the first byte of its SHA-256 modulo fold."""
    return F.conv(F.substring(F.sha2(domain, 256), 1, 2), 16, 10).cast("int") % fold == 0


def use_group(use: Column) -> Column:
    """What a property is used for, by the first of the rules that its description fits."""
    u = F.lower(F.coalesce(use, F.lit("")))
    return F.when(u.rlike("resid|condo|single|town home"), "residential").when(u.contains("apart"), "apartments").when(u.contains("commerc"), "commercial").when(u.contains("industr"), "industrial").when(u.contains("vacant") | u.contains("land"), "vacant").otherwise("other")


def use_group_of_states(use: Column, groups: Sequence[str] = ("residential", "commercial", "agricultural", "industrial", "exempt")) -> Column:
    """The variant for several states: the first group whose first six letters the description holds, else residential for homes."""
    u = F.lower(F.coalesce(use, F.lit("")))
    found = [F.when(u.contains(g[:6]), g) for g in groups]
    return F.coalesce(*found, F.when(u.contains("town home") | u.contains("condominium") | u.contains("apartment"), "residential"), F.lit("other"))


def ranged(estimates: DataFrame, errors: DataFrame) -> DataFrame:
    """estimates (state, estimate) with low and high, the median error of the state off: errors (state, mdape). A state that wasn't
    calibrated has no estimate and so no range."""
    e = errors.select("state", "mdape")
    near = estimates.join(F.broadcast(e), "state", "left")  # a row for each state
    value = F.when(F.col("mdape").isNotNull(), F.col("estimate"))
    return near.withColumns({"estimate": value, "low": value * (1 - F.col("mdape")), "high": value * (1 + F.col("mdape"))}).drop("mdape")


#: Fixed value: the uses that have a feature of their own, in the order of the features.
USES = ("residential", "apartments", "commercial", "industrial", "vacant", "other")


def feature_vector(ratio: Column) -> Column:
    """A property's features, in one projection of its columns: assessed, improvement_value, land_value, sqft, year_built, year, land_area,
    use; absent numbers count as 0."""
    c = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    assessed, sqft, built, year = F.greatest(c("assessed"), F.lit(1.0)), c("sqft"), c("year_built"), c("year")
    aged = (built > 1700) & (built <= year)
    share = lambda x: F.when(x > 0, x / assessed).otherwise(0.0)
    use = use_group(F.col("use"))
    return F.array(
        F.log(assessed * ratio), F.log(assessed), share(c("improvement_value")), share(c("land_value")), flag(c("improvement_value") <= 0), F.log1p(sqft), flag(sqft <= 100),
        F.log1p(F.when(sqft > 100, assessed / sqft).otherwise(0.0)), F.log1p(F.when(aged, year - built).otherwise(0.0)), flag(~aged), F.log1p(F.greatest(c("land_area"), F.lit(0.0))), (year - 2021) / 5,
        *[flag(use == g) for g in USES],
    )


def valued(rows: DataFrame, ratios: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], mean: Sequence[float], std: Sequence[float], mdape: float, clamp: float = 3.0) -> DataFrame:
    """rows (state, assessed, ... as in feature_vector) with estimate, low and high (the median error on held-out rows off, which is no
    interval of confidence). ratios: (state, ratio), a row for each calibrated state; another state, and a property without an
    assessed value, has no estimate."""

    @F.pandas_udf(T.DoubleType())
    def correction(x: pd.Series) -> pd.Series:
        h = (np.stack(x.to_list()) - np.asarray(mean)) / np.asarray(std) if len(x) else np.zeros((0, len(mean)))
        for i, (w, bias) in enumerate(layers):
            h = h @ w + bias
            h = np.maximum(h, 0) if i < len(layers) - 1 else h
        return pd.Series(np.clip(h[:, 0], -clamp, clamp))

    known = F.broadcast(ratios.select(F.upper("state").alias("__state"), F.col("ratio").alias("__ratio")))
    out = rows.join(known, F.upper("state") == F.col("__state"), "left")
    out = out.withColumn("__x", correction(feature_vector(F.coalesce("__ratio", F.lit(1.0)))))
    value = F.when(F.col("__ratio").isNotNull() & (F.col("assessed") > 0), F.col("assessed") * F.col("__ratio") * F.exp("__x"))
    return out.withColumns({"estimate": value, "low": value * (1 - mdape), "high": value * (1 + mdape)}).drop("__state", "__ratio", "__x")


def estimate(rows: DataFrame, features: list[str], layers: list[tuple[np.ndarray, np.ndarray]], clamp: float = 3.0) -> DataFrame:
    """rows with estimate: assessed * exp(network), its log clamped; ReLU between the (weights, bias) layers."""

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[features].to_numpy(dtype=float)
            for i, (w, bias) in enumerate(layers):
                x = x @ w + bias
                x = np.maximum(x, 0) if i < len(layers) - 1 else x
            yield b.assign(estimate=b["assessed"] * np.exp(np.clip(x[:, 0], -clamp, clamp)))

    return rows.mapInPandas(forward, rows.schema.simpleString()[7:-1] + ", estimate double")
