"""Dashboards, trends, statistics and filtered lists."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import small_side
from tidemark.functions.shared import saved


def hours(a: str, b: str) -> Column:
    return (F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600.0


def share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def with_decisions(apps: DataFrame, decisions: DataFrame) -> DataFrame:
    return apps.join(decisions.select("application_id", "decision", "premium_adjustment", "decided_at", "rationale"), "application_id", "left")


def rates(df: DataFrame, *keys: str) -> DataFrame:
    """Count, approval rate of the decided, and averages, by keys (or over all)."""
    grouped = df.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), share(F.count_if(F.col("decision") == "APPROVE"), F.count("decision")).alias("approval_rate"), F.avg("overall_score").alias("avg_score"),
        F.sum(F.col("asset_value").cast("double")).alias("insured_value"), F.avg("premium_adjustment").alias("avg_adjustment"))


def dashboard(df: DataFrame) -> DataFrame:
    """One row over all applications."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk"), share(F.count_if(F.col("decision") == "APPROVE"), F.count("decision")).alias("approval_rate"),
        F.avg(hours("created_at", "decided_at")).alias("avg_hours"), F.sum(F.col("asset_value").cast("double")).alias("insured_value"))


def processing(logs: DataFrame, *keys: str) -> DataFrame:
    """Average seconds, success rate, errors and throughput an hour of each process."""
    span = F.greatest((F.unix_timestamp(F.max("created_at")) - F.unix_timestamp(F.min("created_at"))) / 3600.0, F.lit(1.0))
    seconds = F.col("processing_time").cast("double")
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("avg_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"), F.count_if(F.col("status") == "failed").alias("errors"), share(F.count_if(F.col("status") == "completed"), F.count(F.lit(1))).alias("success_rate"), (F.count(F.lit(1)) / span).alias("per_hour"), F.max("created_at").alias("last_run"))


def system_rollup(tasks: DataFrame) -> DataFrame:
    """Over tasks: sums, and the average of averages."""
    return tasks.agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.avg("avg_s").alias("avg_of_avg"), F.max("max_s").alias("max_s"), share(F.sum("n") - F.sum("errors"), F.sum("n")).alias("rate"))


def batch_progress(logs: DataFrame, key: str) -> DataFrame:
    out = logs.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumns({"pending": F.col("total") - F.col("ok") - F.col("failed"), "success_rate": F.col("ok") / F.col("total")})


def confusion(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of binary predictions; 0 where undefined."""
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    n = predictions.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count(F.lit(1)).alias("n"))
    n = n.withColumns({"tn": F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.select("n", share(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Count, percentage of all, and average asset value of each level."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("asset_value").cast("double")).alias("avg_asset"))
    total = by.agg(F.sum("n").alias("all"))  # one row
    return by.crossJoin(F.broadcast(total)).withColumn("percent", F.col("n") * 100.0 / F.col("all")).drop("all")


def histogram(df: DataFrame, key: str, level: str) -> DataFrame:
    """Counts of the levels within each key, as sorted name:count text."""
    by = df.groupBy(key, level).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce(level, F.lit("none")), F.col("n").cast("string")))), "|").alias("levels"))  # few levels


def status_counts(df: DataFrame, as_of: Column) -> DataFrame:
    """Applications by status, and of this and last month."""
    month = F.date_trunc("month", "created_at")
    this = F.date_trunc("month", as_of)
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "analyzed", "completed", "rejected")), F.avg(hours("created_at", "updated_at")).alias("avg_hours"), F.count_if(month == this).alias("this_month"), F.count_if(month == F.add_months(this, -1).cast("timestamp")).alias("last_month"))


#: One in so many ranks is the error of a first look at percentiles; metrics of so many points or fewer are looked at whole.
ACCURACY = 10_000
PERCENTILES = (0.5, 0.95, 0.99)


def metric_stats(points: DataFrame, *keys: str) -> DataFrame:
    """Count, min, max, mean and percentiles by linear interpolation; without keys one row, of zeros over nothing.

    Percentiles are selected in two passes: the first gives each wanted rank a range of values that holds it for
    certain (a sketch's values a little below and above); the second counts what lies below each range, and the values
    inside it. So no task sees more of a metric than a few ten-thousandths of its points (or ACCURACY of them).
    """
    own = points.select(F.lit(1).alias("_one"), *(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("value").cast("double").alias("value"))
    by, margin = ["_one", *(f"_k{n}" for n in range(len(keys)))], 3 / ACCURACY
    shares = [min(1.0, max(0.0, p + d)) for p in PERCENTILES for d in (-margin, margin)]
    summary = own.groupBy(*by).agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.percentile_approx("value", F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("cuts"))
    summary = saved(summary, "metric-summary")
    few, cut = F.col("n") <= ACCURACY, lambda i: F.get("cuts", F.lit(i))
    ranges = F.array(*(F.struct(F.lit(i).alias("i"), F.when(few, F.col("least")).otherwise(cut(2 * i)).alias("low"), F.when(few, F.col("most")).otherwise(cut(2 * i + 1)).alias("high")) for i in range(len(PERCENTILES))))
    sides = summary.select(*(F.col(k).alias(f"{k}_") for k in by), "n", ranges.alias("ranges"))
    same = lambda right: reduce(and_, (F.col(k).eqNullSafe(right[f"{k}_"]) for k in by))
    small = small_side(sides)
    each = own.where("value is not null").join(small, same(small)).select(*by, "n", "value", F.explode("ranges").alias("r")).where(F.col("value") <= F.col("r.high"))
    # what lies below a range is one value, that comes first
    inside = each.groupBy(*by, "n", F.col("r.i").alias("i"), F.when(F.col("value") >= F.col("r.low"), F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("many"))
    upto = F.sum("many").over(Window.partitionBy(*by, "i").orderBy(F.asc_nulls_first("value")))
    ranked = inside.withColumn("upto", upto)
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    at = lambda i, rank: F.max(F.when((F.col("i") == i) & (rank >= F.col("upto") - F.col("many")) & (rank < F.col("upto")), F.col("value")))
    ends = [c for i, p in enumerate(PERCENTILES) for c in (at(i, F.floor(place(p))).alias(f"a{i}"), at(i, F.least(F.floor(place(p)) + 1, F.col("n") - 1)).alias(f"b{i}"))]
    found = ranked.groupBy(*by).agg(*ends).select(*(F.col(k).alias(f"{k}_") for k in by), *(f"{x}{i}" for i in range(len(PERCENTILES)) for x in "ab"))
    both = summary.join(found.hint("merge"), same(found), "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    between = lambda i, p: F.col(f"a{i}") + (place(p) - F.floor(place(p))) * (F.col(f"b{i}") - F.col(f"a{i}"))
    named = [F.col("n"), *(zero(F.col(c), c) for c in ("least", "most", "mean")), *(zero(between(i, p), f"p{round(100 * p)}") for i, p in enumerate(PERCENTILES))]
    out = both.select(*(F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)), *named)
    return out if keys else out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *(zero(F.max(c), c) for c in out.columns[1:]))


def trend(df: DataFrame, at: str, grain: str) -> DataFrame:
    """Counts and means a period, with the change to the period before."""
    by = df.groupBy(F.date_trunc(grain, at).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    before = F.lag("n").over(Window.orderBy("period"))  # a row a period
    return by.withColumns({"change": F.col("n") - before, "growth": (F.col("n") - before) / before})


def exact_mean(name: str) -> Column:
    """The mean of a double column of 12 decimals at most, summed and divided as decimals: the same for any order of rows, and exact at a tie of rounding. Where a value is no such decimal (not finite, 1e12 or more), a sum of doubles."""
    own = F.col(name).try_cast("decimal(24,12)")
    return F.when(F.count(own) == F.count(name), (F.sum(own) / F.nullif(F.count(own), F.lit(0)).cast("decimal(20,0)")).cast("double")).otherwise(F.avg(name))


def metric_trends(df: DataFrame, grain: str, at: str = "created_at") -> DataFrame:
    """df: applications with decision, decided_at, overall_score and premium_adjustment. Six metrics a period, in one pass: metric, period, value (null if nothing was measured), n (what was counted or measured)."""
    waited = F.unix_timestamp("decided_at") - F.unix_timestamp(at)
    chosen = lambda d: F.count_if(F.col("decision") == d)
    six = {
        "applications": (F.count(F.lit(1)).cast("double"), F.count(F.lit(1))), "approvals": (chosen("APPROVE").cast("double"), chosen("APPROVE")), "rejections": (chosen("REJECT").cast("double"), chosen("REJECT")),
        "processing_time": (F.sum(waited) / F.nullif(3600 * F.count(waited), F.lit(0)), F.count(waited)), "risk_scores": (exact_mean("overall_score"), F.count("overall_score")), "premium_adjustments": (exact_mean("premium_adjustment"), F.count("premium_adjustment")),
    }
    rows = df.groupBy(F.date_trunc(grain, at).alias("period")).agg(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value"), n.alias("n")) for m, (v, n) in six.items())).alias("six"))
    return rows.select("period", F.inline("six")).select("metric", "period", "value", "n")


def market_statistics(df: DataFrame, group: str, most: int = 5) -> DataFrame:
    """One row over all markets: how many, applications, approval rate, insured value, applications of each risk level, the markets of the highest approval rates, and those that grow most (growth of the last year above 0)."""
    named = df.where(F.col(group).isNotNull())
    by = market_groups(named, group)
    first = lambda order, name: by.where("growth > 0" if name == "emerging" else "true").orderBy(*order, group).limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*(-F.col(c) for c in ("growth" if name == "emerging" else "approval_rate", "n")), group))), lambda x: x[group]), "|").alias(name))
    levels = {level: F.count_if(F.upper("risk_level") == level.upper()).alias(level) for level in ("low", "medium", "high", "critical")}
    totals = named.agg(F.count_distinct(group).alias("markets"), F.count(F.lit(1)).alias("n"), share(F.count_if(F.col("decision") == "APPROVE"), F.count("decision")).alias("approval_rate"), F.sum(F.col("asset_value").cast("double")).alias("insured_value"), *levels.values())
    top, emerging = (first([F.desc(c), F.desc("n")], name) for c, name in (("approval_rate", "top"), ("growth", "emerging")))
    return totals.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(emerging))  # a row each


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a list in a total order, with the total count and whether there are pages before and after."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumns({"has_previous": F.lit(number > 1), "has_next": F.col("total") > number * size})


def listed_applications(apps: DataFrame, documents: DataFrame, scores: DataFrame, status: str | None, search: str | None) -> DataFrame:
    """Applications of a status whose id or any file name holds the text; a missing score counts as 0."""
    names = documents.groupBy("application_id").agg(F.max(F.lower("filename").contains(search or "")).alias("named"))
    out = apps.join(names, "application_id", "left").join(scores.select("application_id", "overall_score"), "application_id", "left").withColumn("overall_score", F.coalesce("overall_score", F.lit(0.0)))
    if status:
        out = out.where(F.col("status") == status)
    if search:
        out = out.where(F.lower("application_id").contains(search) | F.coalesce("named", F.lit(False)))
    return out.drop("named")


def searched(view: DataFrame, since: str | None = None, until: str | None = None, least: float | None = None, most: float | None = None, sector: str | None = None, place: str | None = None, text: str | None = None) -> DataFrame:
    """Conjunction of the given conditions over the joined view."""
    conditions = [
        (since, lambda: F.col("created_at") >= F.lit(since).cast("timestamp")), (until, lambda: F.col("created_at") < F.lit(until).cast("timestamp")), (least, lambda: F.col("asset_value") >= least), (most, lambda: F.col("asset_value") <= most),
        (sector, lambda: F.col("industry_sector") == sector), (place, lambda: F.lower("location").contains(place.lower())), (text, lambda: F.lower(F.concat_ws(" ", "application_id", "occupancy", "asset_type")).contains(text.lower())),
    ]
    for value, condition in conditions:
        if value is not None:
            view = view.where(condition())
    return view


LEVELS = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3}


def log_query(logs: DataFrame, least: str, since: str, until: str, limit: int) -> DataFrame:
    """The newest entries of a level or above within a time range."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("level"))
    kept = logs.where((rank >= LEVELS[least]) & (F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.col("created_at") < F.lit(until).cast("timestamp")))
    return kept.orderBy(F.desc("created_at"), "event_id").limit(limit)


def alerts(tasks: DataFrame, limit: int = 10) -> DataFrame:
    """Rules over task metrics: many failures, slow processes; the worst first."""
    failing = tasks.where(F.col("success_rate") < 0.9).select(F.col("process_type").alias("source"), F.lit("reliability").alias("category"), F.when(F.col("success_rate") < 0.5, "critical").otherwise("warning").alias("severity"), F.round("success_rate", 4).alias("value"))
    slow = tasks.where(F.col("avg_s") > 50).select(F.col("process_type").alias("source"), F.lit("latency").alias("category"), F.lit("info").alias("severity"), F.round("avg_s", 4).alias("value"))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return failing.unionByName(slow).orderBy(rank, "category", "source").limit(limit)


WORKFLOW = {"pending": "PENDING", "processing": "STARTED", "analyzed": "PROGRESS", "completed": "SUCCESS", "rejected": "FAILURE"}
RECOVERY = {"ocr": "retry_with_fallback", "timeout": "retry_with_longer_timeout", "error": "manual_review", "click": "retry", "view": "skip"}


def mapped(column: str, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column)), F.lit(default))


def history(apps: DataFrame, documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Everything that happened to applications, as rows in one shape."""
    shape = lambda df, at, kind, detail: df.select("application_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), detail.alias("detail"))
    return shape(apps, "created_at", "created", F.lit("")).unionByName(shape(apps, "updated_at", "status", F.col("status"))).unionByName(shape(documents, "uploaded_at", "upload", F.col("filename"))).unionByName(shape(decisions, "decided_at", "decision", F.col("decision")))


def quick_summary(apps: DataFrame, documents: DataFrame, decisions: DataFrame, length: int = 60) -> DataFrame:
    counts = documents.groupBy("application_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if("processed").alias("processed"))
    cut = F.when(F.length("rationale") > length, F.concat(F.substring("rationale", 1, length), F.lit("..."))).otherwise(F.col("rationale"))
    return apps.join(counts, "application_id", "left").join(decisions, "application_id", "left").select("application_id", "status", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("processed", F.lit(0)).alias("processed"), "decision", cut.alias("rationale"))


def document_dashboard(documents: DataFrame, recent: int = 5) -> DataFrame:
    """Counts, and the most recent uploads."""
    n = documents.agg(F.count(F.lit(1)).alias("total"), F.count_if("processed").alias("processed"))
    newest = documents.orderBy(F.desc("uploaded_at"), "document_id").limit(recent)
    return newest.select("document_id", "filename").crossJoin(F.broadcast(n)).withColumn("pending", F.col("total") - F.col("processed"))


def latest_kept(entries: DataFrame, keep: int = 1000) -> DataFrame:
    """The newest entries (a cache's bound)."""
    return entries.orderBy(F.desc("created_at"), "event_id").limit(keep)


def market_groups(df: DataFrame, group: str) -> DataFrame:
    """Applications, approval rate, average premium adjustment and share of each group, and growth over its last two years."""
    by = rates(df, group)
    total = by.agg(F.sum("n").alias("all"))  # one row
    years = df.groupBy(group, F.year("created_at").alias("year")).agg(F.count(F.lit(1)).alias("n_year"))
    before = F.lag("n_year").over(Window.partitionBy(group).orderBy("year"))
    last = years.withColumn("growth", (F.col("n_year") - before) / before).groupBy(group).agg(F.max_by("growth", "year").alias("growth"))
    return by.crossJoin(F.broadcast(total)).withColumn("market_share", F.col("n") / F.col("all")).drop("all").join(last, group)


def market_trend(df: DataFrame, group: str, grain: str = "quarter") -> DataFrame:
    """Approval, score, insured value and concentration (the sum of squared shares of the groups) a period."""
    with_period = df.withColumn("period", F.date_trunc(grain, "created_at"))
    parts = with_period.groupBy("period", group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "APPROVE").alias("ok"), F.count("decision").alias("decided"), F.sum("overall_score").alias("score"), F.sum(F.col("asset_value").cast("double")).alias("insured_value"))
    total = F.sum("n")
    return parts.groupBy("period").agg(total.alias("n"), share(F.sum("ok"), F.sum("decided")).alias("approval_rate"), (F.sum("score") / total).alias("avg_score"), F.sum("insured_value").alias("insured_value"), (F.sum(F.col("n") * F.col("n")) / (total * total)).alias("concentration"))
