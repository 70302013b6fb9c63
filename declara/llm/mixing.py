"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks (DataFrame functions only).

The budget of the mix, counted in blocks of ``block`` words, is apportioned to sources by highest
quotients ``target / (2 s + 1)``; the blocks of a source are apportioned to its shards by the same rule with
the words of the shards as weights.  Inside a shard documents lie on a line in a seeded order, and the quota
is taken as whole rounds of the line plus a run of blocks that starts at a seeded block.

* Shards hold about ``shard_words`` words whatever the size of their source, so no window grows with a hot
  source.  The only tables with one row per source or per shard are aggregates.
* Of the quotients only those near the cut are formed: with ``n`` parties, budget ``Q`` and weights summing to
  ``V`` the common divisor lies between ``V / (Q + n / 2)`` and ``V / (Q - n / 2)``, which bounds the seats of
  each party from both sides to about three candidates per party on average.

Defined results: null text has size 0 and is never taken; a null source is a source of its own and comes last;
a null id is an id like any other; repeated rows are separate documents; an empty table gives no rows.
Only the named columns are read, so extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.llm.common import WORD, fresh
from declara.session import stored


def _number(text: Column) -> Column:
    """A number below 2^32 from the digest of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], budget: str, weight: str, order: list[str]) -> DataFrame:
    """Sainte-Lague seats of every party: ``parties`` with a column ``seats``.

    ``budget`` is the same for all rows of a group; ties between quotients go to the party first in ``order``.
    Parties of weight 0 get nothing.
    """
    whole = Window.partitionBy(*group)
    p = (parties.withColumn("_v", F.sum(weight).over(whole))
         .withColumn("_n", F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(whole)))
    share = F.when(F.col("_v") > 0, F.col(weight) / F.col("_v")).otherwise(F.lit(0.0))
    p = (p.withColumn("_low", F.greatest(F.lit(0), F.floor(share * (F.col(budget) - F.col("_n") / 2) - 0.5)).cast("long"))
         .withColumn("_high", F.greatest(F.col("_low"), F.floor(share * (F.col(budget) + F.col("_n") / 2) + 0.5).cast("long"))))
    p = p.withColumn("_left", F.col(budget) - F.sum("_low").over(whole))
    tried = p.select(*group, *order, weight, "_left", "_low",
                     F.explode(F.sequence("_low", F.col("_high"))).alias("_s")).filter(F.col(weight) > 0)
    ranked = tried.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(
        (F.col(weight) / (2 * F.col("_s") + 1)).desc(), *order, "_s")))
    won = ranked.filter("_rank <= _left").groupBy(*group, *order).agg(F.count("*").alias("_won"))
    keys = [*group, *order]
    return (p.join(won, keys, "left").withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0).cast("long")))
            .drop("_v", "_n", "_low", "_high", "_left", "_won"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: rank, source, source_size, target.

    Targets share the sum of all sizes by weight and stop at ``most`` times the size of their source; what is
    cut off is shared again by weight.  The level reached is found in one pass over sources ordered by the
    level at which each is full.
    """
    by_name = Window.partitionBy().orderBy(F.asc_nulls_last("source"))
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("rank", F.row_number().over(by_name))
         .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                       ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
         .withColumn("most", (F.lit(most) * F.col("source_size")).cast("double")))
    full = Window.partitionBy().orderBy(F.col("most") / F.col("w"), "rank")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = (s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                      / F.sum("w").over(after))
         .withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(
             F.col("most") / F.col("w"), "rank", "level"))).over(everything)["level"]))
    return s.select("rank", "source", "source_size", F.least(F.col("level") * F.col("w"), F.col("most")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 16, shard_words: int = 250_000,
        seed: str = "mix") -> DataFrame:
    """Words taken of every document: doc_id, digest, source, size, source_size, target, taken.

    ``digest`` (xxhash64 of the text) tells texts apart that share an id.  Weights repeat over the sources in
    code point order.  A document is taken at most ``most`` times.
    """
    sizes = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("digest"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = source_targets(sizes, weights, most)
    budget = F.round(F.sum("source_size").over(Window.partitionBy()) / block).cast("long")
    sources = stored(apportion(sources.withColumn("budget", budget), [], "budget", "target", ["rank"])
                     .select("rank", "source", "source_size", "target", F.col("seats").alias("blocks")), "sources")

    row = F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("digest").cast("string"))
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    lined = (sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
             .drop("_source").withColumn("shard", F.pmod(_number(row), shards_of)))
    shards = (lined.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks")))
    quotas = apportion(shards, ["rank"], "blocks", "words", ["shard"])
    take = F.least(F.col("seats") * block, F.lit(most) * F.col("words"))
    quotas = (quotas.withColumn("take", take)
              .withColumn("rounds", F.when(F.col("words") > 0, F.floor(F.col("take") / F.greatest("words", F.lit(1)))).otherwise(0).cast("long"))
              .withColumn("rest", F.col("take") - F.col("rounds") * F.col("words"))
              .withColumn("start", block * F.pmod(_number(F.concat_ws(":", F.lit(seed), "rank", "shard")),
                                                  F.greatest(F.lit(1), F.floor(F.col("words") / block)).cast("long")))
              .select("rank", "shard", "words", "rounds", "rest", "start"))
    line = (Window.partitionBy("rank", "shard").orderBy(F.md5(row), "doc_id", "digest", "size")
            .rowsBetween(Window.unboundedPreceding, 0))
    placed = lined.withColumn("_end", F.sum("size").over(line)).join(quotas, ["rank", "shard"])
    first, last, stop = F.col("_end") - F.col("size"), F.col("_end"), F.col("start") + F.col("rest")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(last, high) - F.greatest(first, low))

    run = overlap(F.col("start"), stop) + overlap(F.lit(0).cast("long"), stop - F.col("words"))
    return placed.select("doc_id", "digest", "source", "size", "source_size", "target",
                         (F.col("rounds") * F.col("size") + run).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole number of times.

    Rows of one id and text are one document: what is taken of them together is given out by one of them.
    """
    taken = mix(docs, **options).filter("size > 0 and taken > 0").groupBy("doc_id", "digest").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("size"))
    who, what, times, own, one = fresh(docs, "_doc", "_digest", "_copies", "_text_digest", "_copy")
    copies = taken.select(F.col("doc_id").alias(who), F.col("digest").alias(what),
                          F.round(F.col("taken") / F.col("size")).cast("int").alias(times)).filter(F.col(times) > 0)
    keyed = docs.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own])
    return (keyed.join(copies, keyed["doc_id"].eqNullSafe(copies[who]) & (F.col(own) == F.col(what)))
            .withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
