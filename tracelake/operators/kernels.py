"""Window kernels that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Steps in a slice of a history, a power of two. Windows run within a slice of a key, and a row for each slice
#: carries over what came before or comes after, so no task orders the whole history of a thread.
SLICE = 1 << 20


def slice_of(step: str) -> Column:
    return F.shiftright(F.col(step).cast("long"), SLICE.bit_length() - 1)


def _grouped(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """rows with __group, keys and slice in one value that is never null, so joins on it match nulls and take the windows' partitions as they are."""
    return rows.withColumn("__group", F.struct(*keys, slice_of(step).alias("__slice")))


def _over_slices(keys: list[str], behind: bool = False):
    """A window over rows of __group, a key's slices in order, from the last on if behind."""
    at = F.col("__group")["__slice"]
    return Window.partitionBy(*(F.col("__group")[k] for k in keys)).orderBy(at.desc() if behind else at)


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """rows with the columns that carried has for their group."""
    renamed = carried.withColumnRenamed("__group", "__of")
    return rows.join(renamed, F.col("__group") == F.col("__of"), "left").drop("__group", "__of")


def asof_last(probes: DataFrame, facts: DataFrame, keys: list[str], probe_order: str, fact_order: list[str], *values: str) -> DataFrame:
    """probes with values of the last fact of the same keys at or before probe_order, null if there is none.

    Facts at equal order count as before the probe, and of facts at one time the last by the rest
    of fact_order wins. One shuffle on keys and slice serves both sides: rows are tagged, united, and a
    running window carries the last fact along. Each slice begins with the last fact before it.
    """
    names = probes.columns
    fact = F.struct(*values)
    own = [f"__k{i}" for i in range(len(keys))]
    rest = [f"__o{i}" for i in range(len(fact_order) - 1)]
    tagged = probes.select(
        *(F.col(k).alias(n) for k, n in zip(keys, own)), F.col(probe_order).alias("__at"), F.lit(1).alias("__side"),
        *(F.lit(None).cast(facts.schema[o].dataType).alias(n) for o, n in zip(fact_order[1:], rest)),
        F.struct(*names).alias("__probe"), F.lit(None).cast(facts.select(fact).schema[0].dataType).alias("__fact"),
    )
    nobody = F.lit(None).cast(tagged.schema["__probe"].dataType).alias("__probe")
    known = facts.select(
        *(F.col(k).alias(n) for k, n in zip(keys, own)), F.col(fact_order[0]).alias("__at"), F.lit(0).alias("__side"),
        *(F.col(o).alias(n) for o, n in zip(fact_order[1:], rest)), nobody, fact.alias("__fact"),
    )
    both = tagged.unionByName(known).withColumn("__slice", slice_of("__at"))
    lasts = both.groupBy(*own, "__slice").agg(F.max_by("__fact", F.when(F.col("__side") == 0, F.struct("__at", *rest))).alias("__fact"))
    slices = Window.partitionBy(*own).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("__fact", F.last("__fact", ignorenulls=True).over(slices)).where("__fact is not null")
    carried = carried.select(
        *own, (F.col("__slice") * SLICE).cast(both.schema["__at"].dataType).alias("__at"), F.lit(-1).alias("__side"), *(F.lit(None).cast(both.schema[n].dataType).alias(n) for n in rest), nobody, "__fact", "__slice"
    )
    order = Window.partitionBy(*own, "__slice").orderBy("__at", "__side", *rest)
    found = F.last("__fact", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = both.unionByName(carried).withColumn("__found", found).where("__side = 1")
    return out.select(*(F.col(f"__probe.{n}").alias(n) for n in names), *(F.col(f"__found.{v}").alias(v) for v in values))


def reflected_depth(rows: DataFrame, keys: list[str], order: list[str], change: str) -> DataFrame:
    """rows with depth, the running sum of change that never falls below zero, and depth_before, the same without the row.

    What would take it below is lost, as with a pop from an empty stack: the plain running sum is
    lifted by its lowest value so far. order begins with a step; each slice has the sum and the
    lowest value of those before it from one row.
    """
    parts = _grouped(rows, keys, order[0])
    within = Window.partitionBy("__group").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("__raw", F.sum(change).over(running))
    lows = local.groupBy("__group").agg(F.sum(change).alias("__sum"), F.min("__raw").alias("__low"))
    before = _over_slices(keys).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.withColumn("__sum_before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    lows = lows.withColumn("__low_before", F.least(F.lit(0), F.min(F.col("__sum_before") + F.col("__low")).over(before)))
    local = local.withColumns({"__lowest": F.min("__raw").over(running), "__lowest_before": F.min("__raw").over(within.rowsBetween(Window.unboundedPreceding, -1))})
    both = _with_carried(local, lows.drop("__sum", "__low"))
    lifted = lambda raw, low: F.col("__sum_before") + raw - F.least("__low_before", F.col("__sum_before") + F.col(low))
    depths = both.withColumns({"depth": lifted(F.col("__raw"), "__lowest"), "depth_before": lifted(F.col("__raw") - F.col(change), "__lowest_before")})
    return depths.drop("__raw", "__lowest", "__lowest_before", "__sum_before", "__low_before")


def least_later(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, at_once: bool = False) -> DataFrame:
    """rows with name, the least value of the rows of the same keys behind each, null without one.

    order begins with a step. at_once counts the row itself and all rows of its step, whatever their order.
    """
    parts = _grouped(rows, keys, order[0])
    within = Window.partitionBy("__group")
    behind = within.orderBy(F.desc(order[0])).rangeBetween(Window.unboundedPreceding, 0) if at_once else within.orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    beyond = _over_slices(keys, behind=True).rowsBetween(Window.unboundedPreceding, -1)
    lows = parts.groupBy("__group").agg(F.min(value).alias("__low")).withColumn("__beyond", F.min("__low").over(beyond)).drop("__low")
    both = _with_carried(parts.withColumn("__least", F.min(value).over(behind)), lows)
    return both.withColumn(name, F.least("__least", "__beyond")).drop("__least", "__beyond")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], ahead: bool, **values: str) -> DataFrame:
    """rows with columns of the next row of the same keys (ahead) or the one before, null without one.

    values names them: new column, column of the neighbour. order begins with a step.
    """
    parts = _grouped(rows, keys, order[0])
    near = F.struct(*(F.col(v).alias(n) for n, v in values.items()))
    at = F.struct(*order)
    edge, step = (F.min_by(near, at), F.lead) if ahead else (F.max_by(near, at), F.lag)
    edges = parts.groupBy("__group").agg(edge.alias("__edge")).withColumn("__beyond", step("__edge").over(_over_slices(keys))).drop("__edge")
    both = _with_carried(parts.withColumn("__near", step(near).over(Window.partitionBy("__group").orderBy(*order))), edges)
    both = both.withColumn("__near", F.coalesce("__near", "__beyond"))
    return both.withColumns({n: F.col(f"__near.{n}") for n in values}).drop("__near", "__beyond")


def lock_holds(sync: DataFrame) -> DataFrame:
    """Hold depth of each (lock, thread) after each of its acquire and release events.

    Only successful acquires of holdable kinds count, and releases of holds. Rows keep the event's
    columns and get change (+1 or -1), depth and depth_before.
    """
    from ..schemas import ACQUIRES, HOLD_RELEASES

    change = F.when(F.col("sync_type").isin(*ACQUIRES) & (F.col("result") == "Success"), 1).when(F.col("sync_type").isin(*HOLD_RELEASES), -1)
    rows = sync.withColumn("change", change).where("change is not null")
    keys, order = ["sync_object_addr", "thread_id"], ["step", "ord"]
    return reflected_depth(rows, keys, order, "change")


def hold_intervals(sync: DataFrame) -> DataFrame:
    """(sync_object_addr, thread_id, start_step, start_ord, end_step, end_ord): outermost holds; the end is null while held."""
    depths = lock_holds(sync)
    edges = depths.where("(change = 1 and depth_before = 0) or (change = -1 and depth_before = 1)").select("sync_object_addr", "thread_id", "step", "ord", "change")
    ends = neighbours(edges, ["sync_object_addr", "thread_id"], ["step", "ord"], True, end_step="step", end_ord="ord")
    return ends.where("change = 1").select("sync_object_addr", "thread_id", F.col("step").alias("start_step"), F.col("ord").alias("start_ord"), "end_step", "end_ord")
