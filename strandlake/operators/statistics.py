"""Symbol statistics: alphabets, histograms, contexts of quality runs and integer distributions by largest remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers


def quality_chars(reads: DataFrame, *keep: str) -> DataFrame:
    """keep, pos (from 0), q, base: one row a character."""
    rows = reads.select(*keep, F.length("qual").alias("len"), "seq", F.posexplode(F.split("qual", "")).alias("pos", "q")).where("q <> ''")
    return rows.select(*keep, F.col("pos").cast("bigint").alias("pos"), F.col("len").cast("bigint").alias("len"), "q", F.substr("seq", F.col("pos") + 1, F.lit(1)).alias("base"))


def alphabet(histogram: DataFrame, symbol: str = "q") -> DataFrame:
    """idx from 0 by symbol; the histogram has a row a symbol, so that one task orders a bounded table."""
    return histogram.select(symbol, (F.row_number().over(Window.orderBy(symbol)) - 1).cast("bigint").alias("idx"))


def scaled(histogram: DataFrame, total: int = 256) -> DataFrame:
    """max(1, floor(n * total / sum))."""
    whole = F.sum("n").over(Window.partitionBy())
    return histogram.withColumn("scaled", F.greatest(F.lit(1), F.floor(F.col("n") * total / whole)).cast("bigint"))


def hamilton(histogram: DataFrame, symbol: str, *keys: str, target: int = numbers.PROB_TOTAL) -> DataFrame:
    """prob and cum (exclusive): counts as shares of target by largest remainder, for each group of keys.

    All counts zero: equal shares. A zero count gets no share; a share that rounds down to 0 is lifted to 1 with no remainder. What is missing goes to
    the largest remainders (the first symbol of equals), what is over is taken from the smallest among shares over 1; a symbol changes by 1 at most.
    """
    group = Window.partitionBy(*keys)
    total = F.sum("n").over(group)
    size = F.count(F.lit(1)).over(group)
    base = histogram.withColumns({"_total": total, "_size": size}).withColumn("_n", F.when(F.col("_total") == 0, F.lit(1)).otherwise(F.col("n"))).withColumn("_t", F.when(F.col("_total") == 0, F.col("_size")).otherwise(F.col("_total")))
    whole = F.floor(F.col("_n") * target / F.col("_t"))
    exact = F.expr(f"(_n * {target}) div _t")
    left = F.expr(f"(_n * {target}) % _t")
    lifted = (F.col("_n") > 0) & (whole == 0)
    shared = base.withColumns({"_p": F.when(lifted, F.lit(1)).otherwise(exact), "_frac": F.when(lifted, F.lit(0)).otherwise(left)})
    shared = shared.withColumn("_rem", F.lit(target) - F.sum("_p").over(group))
    up = F.row_number().over(group.orderBy(F.desc("_frac"), symbol))
    down = F.row_number().over(group.orderBy(F.when(F.col("_p") > 1, 0).otherwise(1), "_frac", symbol))
    moved = shared.withColumns({"_up": up, "_down": down})
    prob = F.col("_p") + F.when((F.col("_up") <= F.col("_rem")) & (F.col("_frac") > 0), 1).when((F.col("_down") <= -F.col("_rem")) & (F.col("_p") > 1), -1).otherwise(0)
    out = moved.withColumn("prob", prob.cast("bigint"))
    before = group.orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("cum", F.coalesce(F.sum("prob").over(before), F.lit(0)).cast("bigint")).select(*keys, symbol, "n", "prob", "cum")


def run_contexts(runs: DataFrame, order: int, record: str, *partition: str) -> DataFrame:
    """bin, p1..p<order>, q, n: counts of a run's symbol after those of the runs before it in the partition; the history isn't reset between reads."""
    w = Window.partitionBy(*partition).orderBy(record, "run_no")
    lags = {f"p{i}": F.lag("ch", i).over(w) for i in range(1, order + 1)}
    return runs.withColumns(lags).groupBy("bin", *lags, F.col("ch").alias("q")).agg(F.count(F.lit(1)).alias("n"))


def trusted(contexts: DataFrame, gates: tuple[int, int, int] = (8, 16, 16)) -> DataFrame:
    """trusted: the longest order (3 to 0) whose context has a total at its gate or above, for contexts (p1, p2, p3, n); totals of shorter contexts add up longer ones'."""
    total = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    sums = contexts.withColumns({"_t1": total("p1"), "_t2": total("p1", "p2"), "_t3": total("p1", "p2", "p3")})
    order = F.when(F.col("_t3") >= gates[2], 3).when(F.col("_t2") >= gates[1], 2).when(F.col("_t1") >= gates[0], 1).otherwise(0)
    return sums.withColumn("trusted", order.cast("bigint")).drop("_t1", "_t2", "_t3")


def blend(after: DataFrame, whole: DataFrame, ctx: str, weights: tuple[float, float], thresholds: tuple[int, int]) -> DataFrame:
    """ctx, q, p for every context of `after` (ctx, q, n) and every symbol of `whole` (q, n): their distributions, each weighted by weights and ln(total / threshold + 1).

    `whole` has a row a symbol and the contexts are symbols, so both are small whatever the input.
    """

    def weighted(counts: DataFrame, at: int, *keys: str) -> DataFrame:
        total = F.sum("n").over(Window.partitionBy(*keys))
        return counts.select(*keys, "q", (F.col("n") / total * weights[at] * F.ln(total / thresholds[at] + 1)).alias("p"))

    everywhere = after.select(ctx).distinct().join(F.broadcast(weighted(whole, 1)))
    mixed = weighted(after, 0, ctx).unionByName(everywhere).groupBy(ctx, "q").agg(F.sum("p").alias("p"))
    return mixed.select(ctx, "q", F.round(F.col("p") / F.sum("p").over(Window.partitionBy(ctx)), 6).alias("p"))
