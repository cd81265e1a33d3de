"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target number of words; a target above ``max_repeat`` times the source's
size stops there and the excess goes to the others by weight. Targets become whole quotas of
equal blocks of ``block_words`` words: first over the sources, then over each source's shards,
each time to the highest quotients share / (2 * seats + 1). A shard lines its documents up in a
seeded order, cuts that line into blocks, takes each block (quota // blocks) times and a seeded
choice of quota % blocks blocks once more. A document's share is the overlap of its words with
the blocks taken, so that no document exceeds ``max_repeat`` times its size.

Null text: size 0, nothing taken; such documents are in no shard. Null source: a source of its own, last in the order of
sources. Equal ids are ordered by a hash of their text; rows equal in both stand one after the other, each with words of its
own, and which of them comes first doesn't change the rows returned. A very long document spans as many blocks as it needs. A source without words has target 0. An empty table gives an empty
result. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, global_rank

#: Prime above any number of blocks of a shard, so that i -> (MULTIPLIER * i + c) % n permutes 0..n-1.
MULTIPLIER = 2147483647


def targets(sources: DataFrame, weights: tuple[float, ...], total: float, max_repeat: int) -> DataFrame:
    """Add ``target`` to one row per source with its ``size`` and its ``rank``.

    Each round fixes the sources above their cap and deals the rest out again; only three sums
    a round reach the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    open_ = sources.withColumn("w", F.when(F.col("size") > 0, weight).otherwise(0.0)).withColumn("cap", (max_repeat * F.col("size")).cast("double"))
    level = 0.0
    while True:
        full = F.col("w") * F.lit(level) >= F.col("cap")
        row = open_.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        new = max((total - (row["used"] or 0.0)) / row["w"], level) if row["w"] else float("inf")
        if new <= level * (1 + 1e-12) or new == float("inf"):
            level = max(level, new)
            break
        level = new
    if level == float("inf"):
        return open_.withColumn("target", F.col("cap")).drop("w", "cap")
    return open_.withColumn("target", F.least(F.col("w") * F.lit(level), "cap")).drop("w", "cap")


def apportion(parts: DataFrame, group: list[str], share: str, house: str) -> DataFrame:
    """Add ``seats``: each group's ``house`` seats dealt to its rows by highest Sainte-Lague quotients.

    Rounding share / divisor gives all seats but a few; those are the next (or last) quotients
    of the ordered list, of which each row offers only as many as it could win or lose.
    ``key`` breaks ties. Without ``group`` all rows are one group, which is totalled and ranked
    without bringing it to one task.
    """
    w = Window.partitionBy(*group)

    def total(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.withColumn(name, value.over(w) if group else F.lit(df.agg(value).first()[0]))

    rounded = total(total(parts, F.sum(share), "_sum"), F.count("*"), "_n")
    part = F.when(F.col("_sum") > 0, F.col(share) / F.col("_sum")).otherwise(0.0)
    rounded = rounded.withColumn("seats", F.floor(part * F.col(house) + 0.5))
    rounded = total(rounded, F.sum("seats"), "_seated").withColumn("_open", F.col(house) - F.col("_seated"))
    most = F.ceil((F.abs("_open") + F.col("_n")) * part).cast("long") + 1
    step = F.when(F.col("_open") > 0, F.sequence(F.lit(1).cast("long"), most)).otherwise(
        F.sequence(-F.least(most, F.col("seats")), F.lit(-1).cast("long"))
    )
    offers = (
        rounded.where((F.col("_open") != 0) & (part > 0) & ((F.col("_open") > 0) | (F.col("seats") > 0)))
        .select(*group, "key", share, "seats", "_open", F.explode(step).alias("_step"))
        .withColumn(
            "_quotient",
            F.col(share) / F.when(F.col("_step") > 0, 2 * (F.col("seats") + F.col("_step")) - 1).otherwise(2 * (F.col("seats") + F.col("_step")) + 1),
        )
    )
    order = F.when(F.col("_open") > 0, -F.col("_quotient")).otherwise(F.col("_quotient"))
    order = [order, F.col("key"), F.abs("_step")]
    ranked = offers.withColumn("_at", F.row_number().over(w.orderBy(*order))) if group else global_rank(offers, order, "_at").withColumn("_at", F.col("_at") + 1)
    won = (
        ranked.where(F.col("_at") <= F.abs("_open"))
        .groupBy(*[F.col(g).alias(f"_{g}") for g in group], F.col("key").alias("_key"))
        .agg(F.sum(F.signum("_step")).cast("long").alias("_more"))
    )
    same = F.col("key") == F.col("_key")
    for g in group:
        same = same & (F.col(g) == F.col(f"_{g}"))
    return (
        rounded.join(won, same, "left")
        .withColumn("seats", F.col("seats") + F.coalesce("_more", F.lit(0)))
        .drop("_sum", "_n", "_seated", "_open", "_more", "_key", *[f"_{g}" for g in group])
    )


def words_before(x: Column, block: Column, n: Column, rest: Column, c: Column) -> Column:
    """How often the words before position ``x`` of a block of a shard are taken beyond full rounds."""
    return F.when((F.lit(MULTIPLIER) * block + c) % n < rest, x).otherwise(F.lit(0).cast("long"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share_of_all: float = 1.5,
    max_repeat: int = 2,
    block_words: int = 32,
    shard_words: int = 1_000_000,
    shard_docs: int = 100_000,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken; also shard and place.

    Documents that a block boundary cuts are taken in part, by whole words.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = cut(
        docs.select(
            "doc_id",
            size.alias("size"),
            F.coalesce("source", F.lit("")).alias("_source"),
            F.col("source").isNull().alias("_no_source"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("_seed"),
        )
    )
    keys = ["_no_source", "_source"]
    totals = sized.groupBy(*keys).agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    ranked = cut(global_rank(totals, keys, "rank"))
    all_words = ranked.agg(F.sum("size")).first()[0] or 0
    total = share_of_all * all_words
    source = cut(targets(ranked, weights, total, max_repeat))
    blocks_in_all = source.agg(F.round(F.sum("target") / block_words).cast("long")).first()[0] or 0
    quotas = apportion(source.withColumns({"key": F.col("rank"), "_house": F.lit(blocks_in_all).cast("long")}), [], "target", "_house").select(
        *[F.col(k).alias(f"s{k}") for k in keys],
        F.col("rank").alias("s"),
        F.col("size").alias("source_size"),
        "target",
        F.col("seats").alias("_quota"),
        F.greatest(F.ceil(F.col("size") / shard_words), F.ceil(F.col("n_docs") / shard_docs), F.lit(1)).cast("long").alias("_shards"),
    )
    quotas = cut(quotas)
    placed = sized.join(quotas, (sized["_source"] == F.col("s_source")) & (sized["_no_source"] == F.col("s_no_source"))).withColumn(
        "key", F.pmod("_seed", F.col("_shards"))
    )
    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", *(F.lit(0).cast("long").alias(c) for c in ("taken", "shard", "place")))
    line = Window.partitionBy("s", "key")
    placed = placed.where("size > 0")
    placed = placed.withColumn("_end", F.sum("size").over(line.orderBy("_seed", "doc_id").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("size"))
    placed = cut(placed.drop("_source", "_no_source", "s_source", "s_no_source"))
    shards = placed.groupBy("s", "key").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"))
    dealt = apportion(shards, ["s"], "_words", "_quota").select(
        F.col("s").alias("d_s"),
        F.col("key").alias("d_key"),
        F.ceil(F.col("_words") / block_words).cast("long").alias("_n"),
        "seats",
    )
    out = placed.join(dealt, (F.col("s") == F.col("d_s")) & (F.col("key") == F.col("d_key")))
    n = F.greatest("_n", F.lit(1).cast("long"))
    seats = F.least("seats", max_repeat * F.col("_n"))
    full, rest = F.floor(seats / n), seats % n
    c = F.pmod(F.xxhash64(F.lit(seed), "s", "key"), n)
    first, last = F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words)
    overlap = lambda b: words_before(
        F.least(F.col("_end"), (b + 1) * block_words) - F.greatest(F.col("_start"), b * block_words), b, n, rest, c
    )
    extra = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + overlap(b))
    taken = (full * F.col("size") + extra).cast("long")
    taken_from = out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("key").alias("shard"), F.col("_start").alias("place"))
    return taken_from.unionByName(none)
