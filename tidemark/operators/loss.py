"""Loss history: statistics, trend, confidence."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided level below which a slope counts.
SIGNIFICANT = 0.05


def loss_stats(events: DataFrame) -> DataFrame:
    """One row an application that has events. Days are whole days; fewer than a year counts as a year."""
    amount = F.col("amount").cast("double")
    out = events.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(amount).alias("total"), F.max(amount).alias("largest"), F.avg(amount).alias("mean"), F.stddev_pop(amount).alias("std"),
        F.skewness(amount).alias("skew"), F.kurtosis(amount).alias("kurtosis"), F.percentile(amount, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"),
        F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"),
    )
    years = F.greatest(F.timestamp_diff("DAY", "first_event", "last_event") / F.lit(365.25), F.lit(1.0))
    out = out.withColumn("years", years)
    return out.select(
        "application_id", "n_events", "total", "largest", "mean", F.get("p", F.lit(0)).alias("median"), "std", "skew", "kurtosis", F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"),
        "years", (F.col("total") / F.col("years")).alias("annual"), (F.col("n_events") / F.col("years")).alias("frequency"),
        F.when((F.col("n_events") > 1) & (F.col("mean") > 0), F.col("std") / F.col("mean")).otherwise(0.0).alias("volatility"),
    )


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n points (n >= 3), from the finite series of Student's distribution."""
    df = (n - 2).cast("int")
    theta = F.atan(F.abs(r) * F.sqrt(df / (1 - r * r)) / F.sqrt(df.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    # terms t_k = t_(k-1) * cos^2 * (2k - 1) / 2k for even df, ... * 2k / (2k + 1) for odd df
    def series(count: Column, first: Column, ratio) -> Column:
        start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
        steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, lambda a, k: F.struct((a["term"] * cos2 * ratio(k)).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])

    even = F.sin(theta) * series((df / 2).cast("int"), F.lit(1.0), lambda k: (2 * k - 1) / (2 * k))
    odd = 2 / pi * (theta + F.sin(theta) * series(((df - 1) / 2).cast("int"), F.cos(theta), lambda k: 2 * k / (2 * k + 1)))
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(1 - F.when(df % 2 == 0, even).otherwise(odd))


def loss_trend(events: DataFrame) -> DataFrame:
    """Slope of the amount a day, correlation, p, and the trend; fewer than three events, or no spread, are stable."""
    day = F.unix_timestamp("event_date") / F.lit(86400.0) - F.lit(10000.0)
    amount = F.col("amount").cast("double")
    fitted = events.groupBy("application_id").agg(F.count(F.lit(1)).alias("n_events"), (F.covar_pop(amount, day) / F.nullif(F.var_pop(day), F.lit(0.0))).alias("slope"), (F.covar_pop(amount, day) / F.nullif(F.stddev_pop(day) * F.stddev_pop(amount), F.lit(0.0))).alias("r"), F.max(day).alias("to"), F.min(day).alias("since"))
    usable = (F.col("n_events") >= 3) & (F.col("to") > F.col("since")) & F.col("r").isNotNull()
    fitted = fitted.withColumn("slope", F.when(usable, F.col("slope"))).withColumn("r", F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))))
    fitted = fitted.withColumn("p", p_value(F.col("r"), F.col("n_events")))
    trend = F.when(F.col("p") < SIGNIFICANT, F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")).otherwise("stable")
    return fitted.select("application_id", "n_events", "slope", "r", "p", trend.alias("trend"))


def loss_confidence(n: Column, years: Column, volatility: Column, trend_confidence: Column) -> Column:
    data, time = F.least(F.lit(1.0), n / 10), F.least(F.lit(1.0), years / 5)
    steady = F.greatest(F.lit(0.1), 1 - F.least(volatility, F.lit(1.0)))
    return F.least(F.lit(1.0), data * 0.4 + time * 0.3 + steady * 0.2 + trend_confidence * 0.1)


def loss_score(frequency: Column, volatility: Column, trend: Column) -> Column:
    """0 to 100; 10 without losses."""
    moved = F.when(trend == "increasing", 20.0).when(trend == "decreasing", -10.0).otherwise(0.0)
    raw = F.least(F.lit(50.0), frequency * 10) + F.least(F.lit(30.0), volatility * 30) + moved
    return F.when(frequency == 0, F.lit(10.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def loss_analysis(applications: DataFrame, events: DataFrame) -> DataFrame:
    """Every application with its loss history: zeros, stable and confidence 0 without events. Events are summed up before the join."""
    stats, trend = loss_stats(events), loss_trend(events).drop("n_events")
    both = applications.select("application_id").join(stats, "application_id", "left").join(trend, "application_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    sure = F.coalesce(F.abs(F.col("r")), F.lit(0.0))
    confidence = F.when(F.col("n_events") > 0, loss_confidence(F.col("n_events"), F.col("years"), F.col("volatility"), sure)).otherwise(0.0)
    out = both.select("application_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), *map(zero, ("total", "largest", "mean", "std", "annual", "frequency", "volatility")), F.coalesce("trend", F.lit("stable")).alias("trend"), confidence.alias("loss_confidence"))
    return out.withColumn("loss_score", loss_score(F.col("frequency"), F.col("volatility"), F.col("trend")))
