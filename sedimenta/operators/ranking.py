"""Total orders, caps on group boundaries and page trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.working import materialize


def ranked(df: DataFrame, order: list[Column], most: int | None, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of a total order (None: all), numbered from 1.

    ``most`` is a result's cap. The limit is a distributed top-k, so the window
    that numbers the rows sees that many at most.
    """
    if most is None:
        return _numbered(df, order, name)
    return df.orderBy(*order).limit(most).withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """All rows numbered by a range sort: what a partition holds is written once and counted, and the counts of those before it are added."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(dealt.withColumn("__m", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__m", 33))
    ahead = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition: as many as the session's shuffles have.
    ahead = ahead.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    rank = F.col("__ahead") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1
    return marked.join(F.broadcast(ahead), "__part").withColumn(name, rank).drop("__part", "__ahead", "__m")


def capped(groups: DataFrame, budget: int, rows: str = "names", rank: str = "rank") -> DataFrame:
    """Ranked groups until their rows would go beyond the budget; the first always stays."""
    # A group has a row at least, so no later one can be within the budget.
    groups = groups.where(F.col(rank) <= max(budget, 1))
    running = F.sum(rows).over(W.orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow))
    return groups.withColumn("running", running).where((F.col("running") <= budget) | (F.col(rank) == 1)).drop("running")


def truncation(groups: DataFrame, kept: DataFrame, budget: int, rows: str = "names") -> DataFrame:
    """One row: groups and rows that the cap left out, and the cap."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum(rows), F.lit(0)).alias("f"))
    all_, own = count(groups), count(kept).withColumnsRenamed({"g": "kg", "f": "kf"})
    return all_.crossJoin(F.broadcast(own)).select((F.col("g") - F.col("kg")).cast("long").alias("groups"), (F.col("f") - F.col("kf")).cast("long").alias("files"), F.lit(budget).cast("long").alias("cap"))


def trimmed(page: DataFrame, budget: int, per_group: int, least: int, rank: str = "rank", rows: str = "names") -> DataFrame:
    """A page's groups with ``shown``, the rows of each that fit: a running budget, each group's share held between ``least`` and ``per_group``.

    What a group gets depends on the ones before it, so the sizes of the page,
    which has a fixed number of groups, are folded in order.
    """
    sizes = page.agg(F.sort_array(F.collect_list(F.struct(F.col(rank).cast("long").alias("r"), F.col(rows).cast("long").alias("n")))).alias("all"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.expr("cast(array() as array<struct<r:bigint,shown:bigint>>)").alias("out"))

    def step(state, g):
        room = F.greatest(F.least(state["left"], F.lit(per_group)), F.lit(least)).cast("long")
        kept = F.least(g["n"], room)
        return F.struct(F.greatest(state["left"] - kept, F.lit(0)).cast("long").alias("left"), F.concat(state["out"], F.array(F.struct(g["r"].alias("r"), kept.alias("shown")))).alias("out"))

    shown = sizes.select(F.explode(F.aggregate("all", start, step)["out"]).alias("x")).select(F.col("x.r").alias("__r"), F.col("x.shown").alias("shown"))
    return page.join(F.broadcast(shown), page[rank] == shown["__r"]).drop("__r")
