"""Mixing sources to target weights, with DataFrame operations only.

The texts of a source, by hash bucket of their ids and then by id, are one long run of words, cut into blocks of
``block`` words. The mix is a sequence of slots, ``shard_slots`` to an output shard. Each shard
draws its source counts: of a source's expected share of the slots the whole part is certain, and
the slots that then remain are drawn multinomially, each a source in proportion to the fractions. So
counts stay near their targets even of small sources, which a draw of all slots would miss by many
percent. The k-th slot of a source goes through a pseudorandom permutation of the source's blocks
(swap-or-not rounds, which are a permutation of any range), starting again when all blocks have
been used. No block is used more than ``repeats`` times. Slots and documents are joined by block
index.

Positions come from prefix sums in two levels (sums of buckets of ids, then rows in a bucket),
so no task needs all rows of a source. Every choice is a hash of its position and ``seed``:
runs agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12
SHARD_GROUP = 256
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size) -> target words of each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    words. Targets stop at ``repeats`` times a source's size and the excess is shared by weight
    again: so target = min(cap, level * weight), and the level is found where the caps below it
    and the weights above it use up the total. One row for each source goes through the window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", cycle).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything.partitionBy(F.lit(1))) * F.lit(share))
        .withColumn("all_w", F.sum("w").over(everything.partitionBy(F.lit(1))))
        .withColumn("used", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("used_w", F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("used")) / (F.col("all_w") - F.col("used_w")))
    )
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything.partitionBy(F.lit(1)))
    return s.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))).alias("target"))


def _permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, for any n: swap-or-not rounds."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, other), key, r) % 2 == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def _before(rows: DataFrame, by: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over earlier rows of the same ``by``: of earlier buckets, then within the bucket."""
    frame = (Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, bucket).agg(F.sum(value).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(by).orderBy(bucket).rowsBetween(*frame))
    sums = sums.select(F.col(by).alias("by2"), F.col(bucket).alias("bucket2"), F.coalesce(earlier, F.lit(0)).alias("base"))
    within = F.sum(value).over(Window.partitionBy(by, bucket).orderBy(*order).rowsBetween(*frame))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0)))
    return rows.join(sums, F.expr(f"{by} <=> by2 AND {bucket} = bucket2")).withColumn(out, F.col("base") + F.col("within")).drop("base", "within", "by2", "bucket2")


def _uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = 64,
    shard_slots: int = 4096,
    repeats: int = 2,
    share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 17,
) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target`` (its source's) and ``taken``.

    A null text has no words and nothing is taken from it; null sources are one source, the last.
    Rows with the same id follow each other in their source, a null id's among them; an empty table
    gives no rows. Other columns are not read. A shard draws once for each source and remaining slot,
    and sources are numbered in one window: sources are tens or hundreds, not as many as documents.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )
    sized = cut(sized)
    n_docs = sized.count()
    buckets = max(16, min(1 << 16, n_docs // 250))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, repeats=repeats))
    goals_b = goals.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
    placed = _before(sized, "source", "bucket", ["doc_id", "tie"], "size", "begin").select("doc_id", "source", "size", "begin")
    used = _block_uses(goals_b, block, shard_slots, repeats, seed)
    pieces = (
        placed.where("size > 0")
        .withColumn("index", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
        .withColumn("overlap", F.least(F.col("begin") + F.col("size"), (F.col("index") + 1) * block) - F.greatest("begin", F.col("index") * block))
    )
    took = (
        pieces.join(used.hint("merge"), F.expr("source <=> s3 AND index = i3"))
        .groupBy("doc_id", "source", "begin")
        .agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
        .withColumnsRenamed({"doc_id": "d4", "source": "s4", "begin": "b4"})
    )
    return (
        placed.join(took.hint("merge"), F.expr("doc_id <=> d4 AND source <=> s4 AND begin = b4 AND size > 0"), "left")
        .join(goals.withColumnRenamed("source", "s5"), F.expr("source <=> s5"))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _block_uses(goals: DataFrame, block: int, shard_slots: int, repeats: int, seed: int) -> DataFrame:
    """(s3, i3, times): how often the mix uses each block of each source."""
    one = Window.partitionBy(F.lit(1))
    g = (
        goals.where("blocks > 0")
        .withColumn("mean_block", F.col("source_size") / F.col("blocks"))
        .withColumn("want", F.least(F.col("target") / F.col("mean_block"), F.col("blocks") * F.lit(float(repeats))))
        .withColumn("slots", F.sum("want").over(one))
        .withColumn("shards", F.greatest(F.lit(1), F.round(F.col("slots") / shard_slots)).cast("bigint"))
        .withColumn("expected", F.col("want") / F.col("shards"))
    )
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("fraction", F.col("expected") - F.floor("expected")).withColumn("high", F.sum("fraction").over(order))
    g = g.withColumn("low", F.col("high") - F.col("fraction")).withColumn("key", F.coalesce(F.col("source"), F.lit("\0")))
    # a shard's remaining slots (the fractions' sum, rounded up or down at random) each fall on the line on which the fractions lie end to end
    g = g.withColumn("line", F.sum("fraction").over(one))
    remaining = F.floor(F.col("line") + _uniform(F.col("shard"), F.lit(seed)))
    point = lambda j: _uniform(F.col("shard"), j, F.lit(seed)) * F.col("line")
    draws = F.filter(F.sequence(F.lit(1).cast("bigint"), remaining), lambda j: (point(j) >= F.col("low")) & (point(j) < F.col("high")))
    drawn = F.when(remaining >= 1, F.size(draws)).otherwise(0)
    # few rows become many, in steps, each dealt out before it: groups of shards, shards, slots
    n = _shuffle_partitions(goals)
    last = F.col("shards") - 1
    counts = (
        g.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / SHARD_GROUP))))
        .repartition(n, "source", "group")
        .withColumn("shard", F.explode(F.sequence(F.col("group") * SHARD_GROUP, F.least(last, F.col("group") * SHARD_GROUP + SHARD_GROUP - 1))))
        .withColumn("count", (F.floor("expected") + drawn).cast("bigint"))
        .select("source", "key", "blocks", "group", "shard", "count")
    )
    slots = (
        _before(counts, "source", "group", ["shard"], "count", "start")
        .where("count > 0")
        .repartition(n, "source", "shard")
        .select("source", "key", "blocks", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("slot"))
        .where(F.col("slot") < F.col("blocks") * repeats)
    )
    # the permutation of one turn differs from that of the next
    turn = F.floor(F.col("slot") / F.col("blocks"))
    slots = slots.withColumn("seeded", F.xxhash64("key", turn, F.lit(seed)))
    index = _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("seeded"))
    return slots.select(F.col("source").alias("s3"), index.alias("i3")).groupBy("s3", "i3").agg(F.count(F.lit(1)).alias("times"))
