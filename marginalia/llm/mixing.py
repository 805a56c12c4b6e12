"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's words, in a fixed pseudorandom order of its documents, are packed into blocks of
`BLOCK` words. An output shard has `SHARD` slots; its counts for the sources are a residual multinomial draw: each source
has the whole part of its expected count, and the slots that are left go to sources by independent draws, each with the chance
of its fractional part. (One multinomial over all slots strays from the target by the root of a source's slots: by 5.6 % for a
source of 160 blocks in a table of 200 documents, where this one stays within 3 %.) Slots drawn beyond the most that
a source may give go to sources with room left. The slots of a source, numbered over all shards, map to its blocks through a pseudorandom
permutation of the block indexes for each pass over the source (swap-or-not, which permutes any
range), and the blocks so drawn are joined by index to the documents that they overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, unused

#: Words in a block, slots in a shard.
BLOCK, SHARD = 64, 1 << 16
#: Groups that the documents of one source are dealt to, so that no task sorts a whole source.
DEAL = 1024
#: The mix's words in proportion to all words, and the most that it takes of a source.
SHARE, REPEATS = 1.5, 2.0
WEIGHTS = (3.0, 1.0, 2.0)
#: Rounds of the index permutation.
ROUNDS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources come in code point order, null last, and weigh `weights` in turn. Targets share
    `share` times all sizes by weight; a target stops at `repeats` times its size and the excess
    is shared again. The stopped sources are those with the least room for their weight, so one
    pass over the sources, sorted by room, finds the level that all others get per weight.
    """
    everything = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    room = Window.orderBy("room", "place")
    upto, whole = room.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % n + 1).cast("int"))
    per = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", (F.row_number().over(everything) - 1))
        .withColumn("weight", weight)
        .withColumn("most", repeats * F.col("source_size"))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(whole))
    )
    before_most = F.sum("most").over(upto) - F.col("most")
    before_weight = F.sum("weight").over(upto) - F.col("weight")
    level = (F.col("total") - before_most) / (F.sum("weight").over(whole) - before_weight)
    per = per.withColumn("level", level).withColumn("open", F.col("room") > F.col("level"))
    found = F.min(F.when(F.col("open"), F.struct("room", "place", "level"))).over(whole)["level"]
    return per.select("source", "source_size", "weight", F.when(F.coalesce(F.col("room") <= found, F.lit(True)), F.col("most")).otherwise(F.col("weight") * found).alias("target"))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """x's place in a pseudorandom permutation of 0 .. n-1 that `key` names."""

    def swap(at: Column, turn: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, turn), n) - at, n)
        return F.when(F.pmod(F.xxhash64(key, turn, F.greatest(at, other), F.lit("swap")), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def mixed_sources(docs: DataFrame, seed: int = 1, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes).

    A null text has size 0; a null source is a source of its own. A repeated doc_id makes a row
    each time; of several equal rows the order is open but each gets its own words. An empty table
    gives no rows; columns other than doc_id, text and source are not read, whatever their names.
    No source gives more than twice its blocks, so no document exceeds twice its size. One source alone, or sizes of 0 only, are
    no special case: the mix takes what the target allows, or nothing.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_order"))
    slim = checkpointed(slim.withColumn("_deal", F.pmod(F.col("_order"), F.lit(DEAL)).cast("int")))  # the texts are read once
    per_deal = slim.groupBy("source", "_deal").agg(F.sum("size").alias("_deal_size"))
    before = Window.partitionBy("source").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    per_deal = per_deal.withColumn("_base", F.coalesce(F.sum("_deal_size").over(before), F.lit(0)))
    targets = source_targets(per_deal.withColumnRenamed("_deal_size", "size"))

    plan = targets.select("source", "source_size", "target", F.ceil(F.col("source_size") / block).cast("long").alias("_blocks"), F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).alias("_place"))
    plan = plan.withColumn("_most", (F.lit(REPEATS) * F.col("_blocks")).cast("long"))
    level = F.struct("_place", "target")
    mix = plan.agg(F.array_sort(F.collect_list(level)).alias("_sources"), F.sum("target").alias("_target")).filter("_target > 0")
    mix = mix.withColumn("_slots", F.greatest(F.lit(1), F.round(F.col("_target") / block)).cast("long"))
    shards = mix.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_slots") / shard).cast("long") - 1)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards.withColumn("_size", F.least(F.lit(shard).cast("long"), F.col("_slots") - F.col("_k") * shard)).repartition(parts, "_k")
    expected = F.transform("_sources", lambda x: F.struct(x["_place"].alias("place"), F.floor(x["target"] / F.col("_target") * F.col("_size")).alias("whole"), (x["target"] / F.col("_target") * F.col("_size")).alias("all")))
    shards = shards.withColumn("_expected", expected).withColumn("_left", F.greatest(F.lit(0).cast("long"), F.col("_size") - F.aggregate("_expected", F.lit(0).cast("long"), lambda n, x: n + x["whole"])))
    # Upper ends of the fractional parts, laid end to end; a point of their sum draws a source.
    ends = F.transform("_expected", lambda x, i: F.aggregate(F.slice("_expected", 1, i + 1), F.lit(0.0), lambda n, y: n + y["all"] - y["whole"]))
    shards = shards.withColumn("_ends", ends)
    point = F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), F.col("_k"), F.col("_slot")), F.lit(1 << 40)) / float(1 << 40) * F.element_at("_ends", -1)
    draws = shards.filter("_left > 0").withColumn("_slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left")))).withColumn("_point", point)
    place = F.element_at("_expected", F.least(F.size("_ends"), F.size(F.filter("_ends", lambda e: e <= F.col("_point"))) + 1))["place"]
    fixed = shards.select("_k", F.explode("_expected").alias("_x")).select("_k", F.col("_x.place").alias("_place"), F.col("_x.whole").alias("_count"))
    drawn = fixed.union(draws.select("_k", place.alias("_place"), F.lit(1).cast("long"))).groupBy("_place", "_k").agg(F.sum("_count").alias("_count")).filter("_count > 0")
    upto = Window.partitionBy("_place").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    drawn = checkpointed(drawn.withColumn("_first", F.sum("_count").over(upto) - F.col("_count")))
    # What is drawn beyond the most that a source may give: so many more of sources with room, those with most room first.
    room = plan.join(drawn.groupBy("_place").agg(F.sum("_count").alias("_drawn")), "_place", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    widest = Window.orderBy(F.desc(F.col("_most") - F.col("_drawn")), "_place").rowsBetween(Window.unboundedPreceding, -1)
    free = F.greatest(F.lit(0).cast("long"), F.col("_most") - F.col("_drawn"))
    over = F.sum(F.greatest(F.lit(0).cast("long"), F.col("_drawn") - F.col("_most"))).over(Window.partitionBy())
    more = room.select("_place", F.lit(-1).cast("long").alias("_k"), F.greatest(F.lit(0).cast("long"), F.least(free, over - F.coalesce(F.sum(free).over(widest), F.lit(0)))).alias("_count"), F.col("_drawn").alias("_first")).filter("_count > 0")
    drawn = drawn.select("_place", "_k", "_count", "_first").union(more).join(plan.select("_place", "source", "_blocks"), "_place")

    # A row for each source and shard makes many slots: the rows are dealt out before that.
    drawn = drawn.select("source", "_k", "_blocks", "_first", "_count").repartition(parts, "source", "_k")
    slot = F.col("_slot")
    turn, inside = F.floor(slot / F.col("_blocks")), slot % F.col("_blocks")
    taken_blocks = (
        drawn.withColumn("_slot", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1)))
        .filter(slot < REPEATS * F.col("_blocks"))  # the others' stead is in `more`
        .select(F.xxhash64("source").alias("_source"), permuted(inside, F.col("_blocks"), F.xxhash64(F.lit(seed), "source", turn)).alias("_block"))
        .groupBy("_source", "_block").agg(F.count(F.lit(1)).alias("_times"))
    )

    inner = Window.partitionBy("source", "_deal").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    bases = per_deal.select(F.col("source").alias("_s"), F.col("_deal").alias("_d"), "_base")
    sized = slim.filter("size > 0").join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_deal") == F.col("_d")))
    placed = sized.withColumn("_end", F.col("_base") + F.sum("size").over(inner)).withColumn("_begin", F.col("_end") - F.col("size"))
    pieces = placed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_begin") / block), F.floor((F.col("_end") - 1) / block)))).select(F.xxhash64("source").alias("_source"), "_block", "source", "doc_id", "size", "_begin", "_end")
    overlap = F.least(F.col("_end"), (F.col("_block") + 1) * block) - F.greatest(F.col("_begin"), F.col("_block") * block)
    rows = (
        pieces.join(taken_blocks.hint("merge"), ["_source", "_block"], "left")
        .withColumn("_taken", overlap * F.coalesce(F.col("_times"), F.lit(0)))
        .groupBy("source", "doc_id", "size", "_begin").agg(F.sum("_taken").alias("taken"))
        .select("source", "doc_id", "size", "taken")
        .unionByName(slim.filter("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    )
    known = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each comes taken / size times, and at most twice; those that come no time go. The fraction
    is rounded up with its own chance, by a hash of the row, so that a source's expected words are those taken at any length.

    A document that the mix takes a part of is whole, as its blocks' words only count it. A text
    without words stays once, as the mix has no say on it. Rows that repeat doc_id, source and text
    come as often as the mix takes the first of them. All columns stay.
    """
    own, times_, id_, source_, size_, turn = unused(docs, "own", "times", "id", "source", "size", "turn")
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "source", "size"), F.lit(1 << 40)) / float(1 << 40)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size")) + (F.pmod(F.col("taken"), F.col("size")) / F.col("size") > chance).cast("int")).cast("int")
    taken = mixed_sources(docs, **options).groupBy("doc_id", "source", "size").agg(F.max(times).alias(times_)).select(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_), times_).filter(F.col(times_) > 0)
    sized = docs.withColumn(own, word_count(F.col("text")))
    joined = sized.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_)) & (F.col(own) == F.col(size_)))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times_)))).select(*docs.columns)
