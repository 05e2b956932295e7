"""Mixing sources to target weights by capped water-filling.

Targets: every source starts with its weighted share of the budget; sources above max_epochs times their size are
clamped there and the excess is shared by weight among the others, until none is above. Whole repetitions go to every
document of a source; the fraction that is left goes to a seeded choice of whole documents: those that come first in
the order of a digest of the id, up to the document whose middle passes the wanted number of words. That choice is
found from sums by digest prefix, so no source is ever gathered or sorted in one place.

Cases: null text has size 0; a null source is a source of its own and comes last; documents of size 0 are taken but
count no words; rows with equal ids stand or fall together; an empty table gives an empty table; a corpus without
words has targets of 0; other columns pass through, and columns of the results' names (RESULTS) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save, small_side

#: Leading hex digits of the digest by which a source is summed: 65,536 sums at most a source, and of a source's rows one in 65,536 is sorted in one task.
PREFIX = 4
#: Sources up to which their table is broadcast.
MANY_SOURCES = 50_000


def order_key(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def targets(sources: DataFrame, max_epochs: int = 3, budget: int | None = None) -> DataFrame:
    """sources: source_size, weight (both long), a row a source. Adds target (double). budget: words wanted, all there are unless given.

    Sources are clamped in the order of cap by weight. The level that the others reach is the highest one found when so
    many of the first are clamped.
    """
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(cap / F.col("weight"))
    clamped = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.lit(budget) if budget is not None else F.sum("source_size").over(Window.partitionBy())
    level = F.max((total - clamped) / others).over(Window.partitionBy())
    share = F.greatest(F.col("_level"), F.lit(0.0)) * F.col("weight")
    return sources.withColumn("_level", level).withColumn("target", F.when(cap < share, cap.cast("double")).otherwise(share)).drop("_level")


def plan(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sized: source, size (long), key (digest). One row a source: source_size, weight, target, whole repetitions, cutoff (keys up to it are taken once more)."""
    sized = sized.select(source, "size", "key")
    sums = save(sized.groupBy(source, F.substring("key", 1, PREFIX).alias("prefix")).agg(F.sum("size").alias("size")), "mix-sums")
    ranked = sums.groupBy(source).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))  # a row a source
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    sources = save(ranked.withColumn("weight", F.get(cycle, F.pmod(place - 1, F.lit(len(weights))))), "mix-sources")
    goal = targets(sources, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("part", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    goal = save(goal, "mix-goal")

    # the prefix in which the running sum passes the wanted part
    so_far = Window.partitionBy(source).orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("end", F.sum("size").over(so_far)).withColumn("begin", F.col("end") - F.col("size"))
    same = running[source].eqNullSafe(goal[source])
    edge = running.join(small_side(goal, MANY_SOURCES), same).where((F.col("part") > 0) & (F.col("begin") <= F.col("part")) & (F.col("part") < F.col("end")))
    edge = save(edge.select(running[source].alias("edge_source"), F.col("prefix").alias("edge"), "begin", "part"), "mix-edge")
    near = sized.join(small_side(edge, MANY_SOURCES), sized[source].eqNullSafe(F.col("edge_source")) & (F.substring("key", 1, PREFIX) == F.col("edge")))
    near = near.groupBy("edge_source", "edge", "begin", "part", "key").agg(F.sum("size").alias("size"))
    before = F.col("begin") + F.coalesce(F.sum("size").over(Window.partitionBy("edge_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.when(2 * before + F.col("size") <= 2 * F.col("part"), F.col("key"))
    cut = near.withColumn("taken", taken).groupBy("edge_source").agg(F.coalesce(F.max("taken"), F.first("edge")).alias("cutoff"))
    out = goal.join(cut.hint("merge"), goal[source].eqNullSafe(F.col("edge_source")), "left")
    return save(out.select(goal[source], "source_size", "weight", "target", "whole", "part", F.coalesce("cutoff", F.lit("")).alias("cutoff")), "mix-plan")


#: Columns that `apply` adds.
RESULTS = ("source_size", "weight", "target", "part", "times")


def apply(sized: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """sized with the plan of its source (source_size, weight, target, part: words wanted beyond whole repetitions) and times (how often the document is taken)."""
    named = plan.select(F.col(source).alias("_plan_source"), F.struct(*(c for c in plan.columns if c != source)).alias("_plan"))
    kept = sized.drop(*(c for c in RESULTS if c != source))
    joined = kept.join(small_side(named, MANY_SOURCES), kept[source].eqNullSafe(F.col("_plan_source")))
    times = F.col("_plan.whole") + (F.col("key") <= F.col("_plan.cutoff")).cast("long")
    return joined.select(*kept.columns, *(F.col(f"_plan.{c}").alias(c) for c in RESULTS[:-1]), times.alias("times"))
