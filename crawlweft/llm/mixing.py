"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

Every source is permuted by a seeded hash of doc_id and cut into blocks of that order. A source whose target is e times
its size and a rest gives every block e times and, for the rest, a prefix of the permuted order: whole blocks, and a
hash cut inside one. The drawn blocks of all sources are the tree's quotas: at each node half of the node's blocks,
drawn without replacement, go left, so that the sources' counts on the left follow a multivariate hypergeometric law;
leaves are output shards. Blocks of a source, in permuted order, fill its leaf quotas, disjointly. What a document gives is
what the leaves drew of its block: a copy for each leaf that holds one; draw() orders the rows of each task by shard and by another hash (order_key).

The tree has at most BLOCKS blocks plus a few per source and copy, at any input size: blocks grow with the input, the tree
does not, but for two blocks a source. Tables by source or block are broadcast only while they have at most BROADCAST rows.

Defined cases: sizes count words `[^\\x20\\x09-\\x0D]+`, null text 0; sources rank by code point, null last, as one
source; a source of size 0 has target 0; rows repeated under a doc_id are drawn together; an empty table gives no rows;
columns beside doc_id, source and text are not read by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .runtime import materialize

WEIGHTS, LIMIT, BLOCKS, LEVELS, SEED = (5, 2, 1), 3, 1024, 4, 17
BROADCAST = 1 << 16
_FINE = 1 << 12
_SPAN = 1 << 40


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int) -> Column:
    """The document's place in the permuted order, in [0, _SPAN)."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(_SPAN))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target: shares by weight of all words, none above LIMIT times its source (the excess reshared)."""
    rank = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", cycle)
    s = s.withColumn("most", F.lit(LIMIT) * F.col("source_size"))
    # fill in the order in which sources reach their limit: one is at its limit if its share of what is left exceeds it
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weights).withColumn("turn", F.row_number().over(order))
    # the first source below its limit sets the level of all that come after it
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("turn", "level")))
    s = s.withColumn("level", first.over(everything)["level"])
    return s.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def _tree(drawn: DataFrame, levels: int, seed: int) -> DataFrame:
    """drawn: (source, block, copy). Adds shard, by quotas of the splitting tree."""
    key = lambda *c: F.xxhash64(*c, F.lit(seed))
    unit = W.partitionBy("source").orderBy("copy", key("block"), "block")
    tokens = drawn.withColumn("n", F.row_number().over(unit)).withColumn("node", F.lit(0))
    for level in range(levels):
        within = W.partitionBy("node")
        half = F.floor((F.count("*").over(within) + F.pmod(key("node"), F.lit(2))) / 2)
        rank = F.row_number().over(within.orderBy(key("source", "n", F.lit(level)), F.col("source").asc_nulls_last(), "n"))
        tokens = tokens.withColumn("node", F.col("node") * 2 + F.when(rank <= half, 0).otherwise(1))
    quotas = tokens.groupBy("source", "node").agg(F.count("*").alias("quota"))
    end = F.sum("quota").over(W.partitionBy("source").orderBy("node"))
    quotas = quotas.select(F.col("source").alias("s"), "node", (end - F.col("quota")).alias("from"), end.alias("to"))
    numbered = drawn.withColumn("n", F.row_number().over(unit))
    # a source has at most one quota for each of the tree's leaves
    return numbered.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("n") > F.col("from")) & (F.col("n") <= F.col("to"))).select("source", "block", "copy", F.col("node").alias("shard"))


def plan(docs: DataFrame, *, levels: int = LEVELS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sizes, blocks): sizes has doc_id, source, size, place for each row; blocks has, for each source and block, what of it is drawn."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("place")), "sizes")
    goal = materialize(targets(sizes), "targets")
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    goal = goal.withColumn("blocks", F.ceil(F.lit(BLOCKS) * F.col("source_size") / F.lit(max(total, 1))) + 1)
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    key = goal.select(F.col("source").alias("s"), "source_size", "target", "blocks", "copies", "rest")
    same = F.col("source").eqNullSafe(F.col("s"))
    cell = sizes.join(key, same).withColumn("block", F.floor(F.col("place") * F.col("blocks") / F.lit(_SPAN)))
    inside = F.col("place") * F.col("blocks") % F.lit(_SPAN)
    cell = cell.withColumn("fine", F.floor(inside * F.lit(_FINE) / F.lit(_SPAN)))
    order = W.partitionBy("source").orderBy("block")
    block = cell.groupBy("source", "source_size", "target", "copies", "rest", "block").agg(F.sum("size").alias("words"))
    block = materialize(block.withColumn("before", F.sum("words").over(order) - F.col("words")), "blocks")
    edge = block.where("before < rest and before + words > rest").select(F.col("source").alias("es"), F.col("block").alias("eb"), "before", F.col("rest").alias("need"))
    at_edge = cell.join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")))
    fine = at_edge.groupBy("source", "block", "fine", "before", "need").agg(F.sum("size").alias("words")).withColumn("start", F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("fine")) - F.col("words"))
    fine = fine.where("start < need and start + words >= need").select(F.col("source").alias("fs"), F.col("fine").alias("ff"), F.col("start"), F.col("need").alias("want"))
    last = at_edge.join(fine, F.col("source").eqNullSafe(F.col("fs")) & (F.col("fine") == F.col("ff")))
    last = last.groupBy("source", "start", "want", "place").agg(F.sum("size").alias("words"))
    run = F.col("start") + F.sum("words").over(W.partitionBy("source").orderBy("place"))
    # the cut comes after the last place whose middle is within the rest: half a document off at most
    cuts = last.withColumn("middle", run - F.col("words") / 2).groupBy("source").agg(F.coalesce(F.max(F.when(F.col("middle") <= F.col("want"), F.col("place"))), F.min("place") - 1).alias("cut"))
    cuts = cuts.select(F.col("source").alias("cs"), "cut")
    block = block.join(cuts, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")
    # a block gives one more copy of all its places up to `cut`
    block = block.withColumn("cut", F.when(F.col("before") + F.col("words") <= F.col("rest"), F.lit(_SPAN)).when((F.col("before") < F.col("rest")) & F.col("cut").isNotNull(), F.col("cut")).otherwise(F.lit(-1)))
    block = materialize(block, "draws")
    drawn = block.select("source", "block", F.explode(F.sequence(F.lit(1), (F.col("copies") + F.when(F.col("cut") >= 0, 1).otherwise(0)).cast("int"))).alias("copy")).where("copy > 0")
    drawn = drawn.join(block.select(F.col("source").alias("bs"), F.col("block").alias("bb"), "copies", "cut"), F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb"))).where(F.col("copy") <= F.col("copies") + F.when(F.col("cut") >= 0, 1).otherwise(0)).select("source", "block", "copy")
    shards = _tree(drawn, levels, seed).groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("block_shards"))
    shards = shards.select(F.col("source").alias("ts"), F.col("block").alias("tb"), "block_shards")
    block = block.join(shards, F.col("source").eqNullSafe(F.col("ts")) & (F.col("block") == F.col("tb")), "left")
    count = goal.select(F.col("source").alias("ns"), F.col("blocks"))
    block = block.join(count, F.col("source").eqNullSafe(F.col("ns"))).select("source", "source_size", "target", "blocks", "block", "copies", "cut", "block_shards")
    return sizes, materialize(block, "draws")


def _bounded(table: DataFrame) -> DataFrame:
    """With the hint to broadcast it if it is small; else the join is left to its measured size."""
    return F.broadcast(table) if table.limit(BROADCAST + 1).count() <= BROADCAST else table


def _with_draws(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows have source and place. Adds source_size, target and shards: the shard of each copy drawn of the row."""
    known = blocks.select("source", "blocks").distinct().select(F.col("source").alias("ks"), F.col("blocks").alias("k"))
    rows = rows.join(_bounded(known), F.col("source").eqNullSafe(F.col("ks"))).withColumn("b", F.floor(F.col("place") * F.col("k") / F.lit(_SPAN)))
    draws = blocks.select(F.col("source").alias("ds"), F.col("block").alias("db"), "source_size", "target", "copies", "cut", "block_shards")
    rows = rows.join(_bounded(draws), F.col("source").eqNullSafe(F.col("ds")) & (F.col("b") == F.col("db")))
    # the last copy of the block at the cut is drawn up to there
    drawn = F.slice(F.coalesce("block_shards", F.array().cast("array<int>")), F.lit(1), (F.col("copies") + F.when(F.col("place") <= F.col("cut"), 1).otherwise(0)).cast("int"))
    return rows.withColumn("shards", drawn).drop("ks", "k", "b", "ds", "db", "copies", "cut", "block_shards")


def mixed(docs: DataFrame, *, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words in all shards that drew it), source, times, shards."""
    sizes, blocks = plan(docs, levels=levels, seed=seed)
    out = _with_draws(sizes, blocks).withColumn("times", F.size("shards"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source", "times", "shards")


def draw(docs: DataFrame, *, levels: int = LEVELS, seed: int = SEED, placed: bool = False) -> DataFrame:
    """The mix itself: each row of docs once for every copy, shuffled within each task; placed: with _shard and _order_key (order rows of a shard by it)."""
    _, blocks = plan(docs, levels=levels, seed=seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", place(F.col("doc_id"), seed).alias("place"))
    out = _with_draws(rows, blocks).select("row", F.posexplode("shards").alias("_copy", "_shard"))
    out = out.withColumn("_order_key", F.xxhash64("row.doc_id", "_copy", F.lit(seed + 1))).sortWithinPartitions("_shard", "_order_key")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns), *(["_shard", "_order_key"] if placed else []))
