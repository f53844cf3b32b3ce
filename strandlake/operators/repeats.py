"""Earlier occurrences of a context, by windows over the context's own rows rather than a self-join, so that a frequent context costs its rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna
from .kmers import explode_kmers


def previous_occurrences(reads: DataFrame, k: int, record: str, most: int = 3, canonical: bool = True, span: int = 1 << 16) -> DataFrame:
    """record, pos, ctx, next (the base after it) and prev1..prev<most>: (record, pos, next) of the latest earlier occurrences of the context.

    `record` is a whole number. Contexts are few and some are everywhere, so a window holds the occurrences of a context in `span` successive records only; the last
    `most` of each such stretch are carried on to the stretches after it, and completed for the first rows there.
    """
    rows = explode_kmers(reads, k + 1, record)
    ctx = F.substring("kmer", 1, k)
    rows = rows.select(record, "pos", (dna.canonical_v4(ctx) if canonical else ctx).alias("ctx"), F.substring("kmer", k + 1, 1).alias("next"), F.floor(F.col(record) / span).alias("_span"))
    here = F.struct(F.col(record).alias("record"), "pos", "next")
    w = Window.partitionBy("ctx", "_span").orderBy(record, "pos")
    placed = rows.withColumns({"_at": F.row_number().over(w), **{f"_own{i}": F.lag(here, i).over(w) for i in range(1, most + 1)}})
    backward = Window.partitionBy("ctx", "_span").orderBy(F.desc(record), F.desc("pos"))
    ends = rows.withColumn("_end", F.row_number().over(backward)).where(F.col("_end") <= most)
    ends = ends.groupBy("ctx", "_span").agg(F.transform(F.sort_array(F.collect_list(F.struct("_end", here.alias("x")))), lambda e: e["x"]).alias("_last"))
    stretches = Window.partitionBy("ctx").orderBy("_span").rowsBetween(-most, -1)
    carried = ends.withColumn("_before", F.slice(F.flatten(F.reverse(F.collect_list("_last").over(stretches))), 1, most)).drop("_last")
    joined = placed.join(carried, ["ctx", "_span"])
    latest = F.concat(F.filter(F.array(*[f"_own{i}" for i in range(1, most + 1)]), lambda x: x.isNotNull()), "_before")
    found = joined.withColumn("_all", F.when(F.col("_at") > most, F.array(*[f"_own{i}" for i in range(1, most + 1)])).otherwise(latest))
    return found.select(record, "pos", "ctx", "next", *[F.get("_all", F.lit(i - 1)).alias(f"prev{i}") for i in range(1, most + 1)])


def verified(actual: str, *candidates: str) -> Column:
    """The number of the first candidate that foretells the base, from 1; 0 if none does."""
    out = F.lit(0)
    for i in range(len(candidates), 0, -1):
        out = F.when(F.col(actual) == F.col(candidates[i - 1]), F.lit(i)).otherwise(out)
    return out.cast("bigint")


def copies(reads: DataFrame, record: str, anchors: tuple[int, ...] = (12, 8), near: int = 4) -> DataFrame:
    """record, pos, anchor, channel, source: places whose last `anchor` bases, or their complement, end at `source` earlier in the record.

    For each anchor (the longest first) and channel (direct, complement) the two latest earlier occurrences count; one that starts less than the anchor before is skipped.
    Of sources of one channel within `near` of each other only the first stays: of the longer anchor, then the later one.
    """
    channels = {"direct": F.col("kmer"), "complement": dna.complement("kmer")}
    spots = None
    for k in anchors:
        rows = explode_kmers(reads, k, record).withColumn("anchor", F.lit(k).cast("bigint"))
        spots = rows if spots is None else spots.unionByName(rows)
    sides = F.array(*[F.struct(key.alias("key"), F.lit(asks).alias("asks"), F.lit(name).alias("channel")) for name, image in channels.items() for key, asks in ((F.col("kmer"), True), (image, False))])
    rows = spots.select(record, "anchor", "pos", F.explode(sides).alias("s")).select(record, "anchor", "pos", "s.*")
    own = Window.partitionBy(record, "anchor", "channel", "key", "asks").orderBy("pos")
    rows = rows.withColumn("_pair", F.when(~F.col("asks"), F.struct(F.col("pos").alias("s1"), F.lag("pos").over(own).alias("s2"))))
    earlier = Window.partitionBy(record, "anchor", "channel", "key").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_pair", F.last("_pair", ignorenulls=True).over(earlier)).where("asks and _pair is not null")
    # a source at the same place belongs to the place itself (a k-mer that is its own complement's)
    first = F.when(F.col("_pair.s1") == F.col("pos"), F.col("_pair.s2")).otherwise(F.col("_pair.s1"))
    second = F.when(F.col("_pair.s1") != F.col("pos"), F.col("_pair.s2"))
    both = F.array(F.struct(F.lit(1).alias("r"), first.alias("s")), F.struct(F.lit(2).alias("r"), second.alias("s")))
    found = rows.select(record, "anchor", "channel", "pos", F.explode(both).alias("c")).where(F.col("pos") - F.col("c.s") >= F.col("anchor"))
    found = found.select(record, (F.col("pos") + F.col("anchor")).alias("pos"), "channel", F.struct((-F.col("anchor")).alias("a"), F.col("c.r").alias("r"), (F.col("c.s") + F.col("anchor")).alias("source")).alias("c"))
    # a place has two candidates an anchor at most
    ranked = found.groupBy(record, "pos", "channel").agg(F.sort_array(F.collect_list("c")).alias("all"))
    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: ((y["a"] < x["a"]) | ((y["a"] == x["a"]) & (y["r"] < x["r"]))) & (F.abs(y["source"] - x["source"]) <= near)))
    return ranked.select(record, "pos", "channel", F.explode(kept).alias("c")).select(record, "pos", (-F.col("c.a")).alias("anchor"), "channel", F.col("c.source").alias("source"))


def streaks(hits: DataFrame, hit: str, order: str, *partition: str) -> DataFrame:
    """streak: how many rows up to this one have been hits without a break."""
    w = Window.partitionBy(*partition).orderBy(order)
    island = hits.withColumn("_island", F.sum(1 - F.col(hit)).over(w))
    inside = Window.partitionBy(*partition, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(hit).over(inside)).drop("_island")


def recent_misses(rows: DataFrame, miss: str, order: str, *partition: str, width: int = 32) -> DataFrame:
    """misses: how many of the last `width` rows, this one included, are misses."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(1 - width, 0)
    return rows.withColumn("misses", F.sum(miss).over(w))


def edit_history(rows: DataFrame, miss: str, order: str, *partition: str, bits: int = 16) -> DataFrame:
    """history: the misses of the last `bits` rows as bits, the latest lowest."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(1 - bits, 0)
    shifted = F.transform(F.reverse(F.collect_list(miss).over(w)), lambda m, i: m.cast("bigint") * F.pow(F.lit(2), i).cast("bigint"))
    return rows.withColumn("history", F.aggregate(shifted, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)))


def tolerant(mask: Column, order: int, most: int) -> Column:
    """Whether at most `most` of the last `order` bits of a history of edits are set."""
    return F.bit_count(mask.bitwiseAND(F.lit((1 << order) - 1))) <= most


def moving_average(values: Column, alpha: float = 0.05) -> Column:
    """The exponential moving average of an array's numbers, from 0."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - acc) * alpha)
