"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas, DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut


def size_of(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit(*key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources(source, source_size) with `target`: weights repeat over the sources by code point, null last.

    A target is level * weight, at most `most` times its source's size, with the level at which all targets sum to `share` of
    all sizes. This is where resharing the excess by weight comes to rest. The windows run over one row for each source.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    s = sources.withColumn("weight", F.element_at(cycle, (F.row_number().over(w) - 1) % len(weights) + 1)).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    below = by.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - full) / rest)
    # The first source, by cap per weight, whose cap is not below its level: the level of it and of all after it.
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return s.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(take: Column, marked: Column, total: Column, u: Column) -> Column:
    """How many of `marked` among `total` blocks are in a draw of `take`, by inverting the distribution at u.

    Terms follow from the ratio of neighbours, so no factorial is needed; those more than 12 standard deviations from the
    mode, of weight below 1e-30, are left out. Two folds over the terms: their sum, then the place where it passes u.
    """
    one = F.lit(1.0)
    mode = lambda c: F.floor((c["t"] + 1) * (c["m"] + 1) / (c["n"] + 2))
    wide = lambda c: F.ceil(12 * F.sqrt(c["t"] * (c["m"] / F.greatest(F.lit(1), c["n"])) * (1 - c["m"] / F.greatest(F.lit(1), c["n"]))) + 12)

    def ends(c: Column) -> Column:
        least, most = F.greatest(F.lit(0), c["t"] + c["m"] - c["n"]), F.least(c["t"], c["m"])
        return F.struct(c["t"].alias("t"), c["m"].alias("m"), c["n"].alias("n"), F.least(most, F.greatest(least, mode(c) - wide(c))).cast("long").alias("low"), F.greatest(least, F.least(most, mode(c) + wide(c))).cast("long").alias("high"))

    def draw(c: Column) -> Column:
        step = lambda k: (c["m"] - k) * (c["t"] - k) / ((k + 1) * (c["n"] - c["m"] - c["t"] + k + 1))  # noqa: E731  weight(k + 1) / weight(k)
        after = lambda a, k: F.when(k < c["high"], a["v"] * step(k)).otherwise(a["v"])
        terms = F.sequence(c["low"], c["high"])
        mass = F.aggregate(terms, F.struct(one.alias("v"), F.lit(0.0).alias("sum")), lambda a, k: F.struct(after(a, k).alias("v"), (a["sum"] + a["v"]).alias("sum")))["sum"]
        start = F.struct(one.alias("v"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))
        found = lambda goal: F.aggregate(terms, start, lambda a, k: F.struct(after(a, k).alias("v"), (a["sum"] + a["v"]).alias("sum"), F.when((a["k"] < 0) & (a["sum"] + a["v"] > goal), k).otherwise(a["k"]).alias("k")))["k"]
        return let(let(u * mass, found), lambda k: F.when(k < 0, c["high"]).otherwise(k))

    return let(let(F.struct(take.cast("long").alias("t"), marked.cast("long").alias("m"), total.cast("long").alias("n")), ends), draw)


def multivariate(has: Column, take: Column, total: Column, *key: Column) -> Column:
    """How many blocks each of has(no, quota) gives to a draw of `take` from all `total`: the parts in order, each hypergeometric given those before."""

    def draw(a: Column, x: Column) -> Column:
        n = hypergeometric(a["take"], x["quota"], a["left"], unit(*key, x["no"]))
        return let(n, lambda n: F.struct((a["left"] - x["quota"]).alias("left"), (a["take"] - n).alias("take"), F.concat(a["out"], F.array(n)).alias("out")))

    return F.aggregate(has, F.struct(total.alias("left"), take.alias("take"), F.array().cast("array<bigint>").alias("out")), draw)["out"]


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """quotas(source_no, quota) dealt to 2**depth shards: (source_no, shard, quota), with nothing lost.

    At each node half of the blocks, drawn without replacement, go left, and the sources' parts of the draw are multivariate
    hypergeometric. The draw is made in two steps that have the same distribution as one: first for chunks of sources, then inside
    each chunk. A chunk holds the square root of the number of sources, so no row holds more than that many quotas.
    """
    width = max(1, math.isqrt(quotas.count()))
    zero, quota = F.lit(0).cast("long"), F.struct(F.col("source_no").cast("long").alias("no"), F.col("quota").cast("long").alias("quota"))
    level = quotas.groupBy(F.lit(0).alias("node"), F.floor(F.col("source_no") / width).alias("chunk")).agg(F.array_sort(F.collect_list(quota)).alias("has"))
    for at in range(depth):
        level = level.withColumn("total", F.aggregate("has", zero, lambda a, x: a + x["quota"]))
        nodes = level.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("no"), F.col("total").alias("quota")))).alias("chunks"), F.sum("total").alias("all"))
        half = F.floor((F.col("all") + F.col("node") % 2) / 2)
        taken = multivariate(F.col("chunks"), half, F.col("all"), F.lit(seed), F.lit(at), F.lit("chunk"), F.col("node"))
        takes = nodes.select("node", "chunks", taken.alias("take")).select("node", F.inline(F.arrays_zip("chunks", "take"))).select("node", F.col("chunks.no").alias("chunk"), "take")
        left = multivariate(F.col("has"), F.col("take"), F.col("total"), F.lit(seed), F.lit(at), F.lit("source"), F.col("node"))
        level = level.join(takes, ["node", "chunk"]).select("node", "chunk", "has", left.alias("left"))
        part = lambda side: F.transform(F.arrays_zip("has", "left"), lambda x: F.struct(x["has"]["no"].alias("no"), (x["left"] if side == 0 else x["has"]["quota"] - x["left"]).alias("quota")))
        sides = F.array(*[F.struct((F.col("node") * 2 + side).alias("node"), "chunk", part(side).alias("has")) for side in (0, 1)])
        level = cut(level.select(F.inline(sides)))
    return level.select(F.col("node").alias("shard"), F.inline("has")).select(F.col("no").cast("int").alias("source_no"), "shard", "quota")


def block_numbers(share: Column, blocks: int) -> Column:
    """Into how many blocks a source is dealt: a power of two that grows with its share of all words, `blocks` from 1/64 of them on.

    So all sources together have no more than 128 * blocks blocks and one more for each source.
    """
    return F.least(F.lit(blocks), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(share * 64 * blocks, F.lit(1.0))))))).cast("long")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    depth: int | None = None, blocks: int = 1024, shard_words: int = 1 << 22, seed: int = 7, broadcast_rows: int = 100_000,
) -> DataFrame:
    """Mix documents so that each source supplies its target number of words.

    Returns each input row inside `row` (no name can clash), with id, size, source_size, target, taken (words, repeats
    counted) and draws, an array of (shard, copy, words, position): the row goes to that output shard, with so many of its
    words, at that place of the shard's local order. A word is `[^\\x20\\x09-\\x0D]+`; null or empty texts have size 0 and
    are never drawn; a null source is a source of its own, last in order. Weights repeat over the sources by code point.

    The documents of a source are dealt by hash to at most `blocks` blocks (see block_numbers). Its target is filled by whole
    blocks in a permuted order, a second permuted pass following the first, so no document is taken more than `most` times. The last
    block is filled by whole cells (of `blocks` cells of a source, dealt by the same hash) in a permuted order; in the last cell each
    document gives the same share of its words, rounded up or down by a hash. Blocks are exact quotas that the splitting tree deals to
    2**depth shards (by default as many as give each shard about shard_words words, 8 at least). Reruns agree: every choice is
    a hash of id, source and seed. Repeated ids share a block, not a decision. An empty table gives an empty result.

    Up to broadcast_rows sources, the plan is broadcast and no text is shuffled; beyond it, rows and plan meet by source and
    block, so that a source which holds a third of all rows is `blocks` keys.
    """
    key = F.col(source_col).cast("string").alias("source")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key, F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"))
    rows = rows.withColumn("fine", F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), blocks))
    fine = cut(rows.groupBy("source", "fine").agg(F.sum("size").alias("words")))
    sources = targets(fine.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    sources = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    sources = cut(sources.withColumn("n_blocks", block_numbers(F.col("source_size") / F.nullif(F.sum("source_size").over(Window.partitionBy()), F.lit(0)), blocks)))
    n_sources, drawn = sources.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    depth = min(20, max(3, math.ceil(math.log2(max(1.0, drawn / shard_words))))) if depth is None else depth
    known = sources.select(F.col("source").alias("_s"), "source_no", "n_blocks", "source_size", "target")
    small = n_sources <= broadcast_rows
    with_source = lambda left: left.join(F.broadcast(known) if small else known, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("block", F.pmod("fine", "n_blocks"))
    named = with_source(fine)
    passes = int(-(-most // 1))
    order = Window.partitionBy("source_no").orderBy("copy", F.xxhash64(F.lit(seed), "source_no", "copy", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = (
        named.where("words > 0").groupBy("source_no", "block").agg(F.sum("words").alias("words"), F.first("target").alias("target"))
        .select("source_no", "target", "block", "words", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("copy"))
        .withColumn("part", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("target") - before) / F.col("words")))).where("part > 0")
        .withColumn("turn", F.row_number().over(Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 1), "copy", "block"), "copy", "block")))
    )
    copies = cut(copies)
    cells = named.where("words > 0").select("source_no", "block", "fine", F.col("words").alias("cell_words")).join(copies.where("part < 1").select("source_no", "block", "copy", (F.col("part") * F.col("words")).alias("goal")), ["source_no", "block"])
    place = lambda copy, fine: F.xxhash64(F.lit(seed + 3), F.col("source_no"), copy, fine)
    cells = cells.withColumn("edge", place(F.col("copy"), F.col("fine")))
    filled = F.sum("cell_words").over(Window.partitionBy("source_no", "copy").orderBy("edge", "fine"))  # at most `blocks` cells
    edges = cells.withColumn("over", filled - F.col("goal")).where("over >= 0 and over < cell_words").select("source_no", "copy", "edge", (1 - F.col("over") / F.col("cell_words")).alias("edge_part"))
    copies = cut(copies.join(edges, ["source_no", "copy"], "left").withColumn("edge", F.when(F.col("part") < 1, F.col("edge"))))
    leaves = splitting_tree(copies.groupBy("source_no").agg(F.count("*").alias("quota")), depth, seed)
    upto = F.sum("quota").over(Window.partitionBy("source_no").orderBy("shard"))
    ranges = leaves.select("source_no", "shard", (upto - F.col("quota")).alias("from_turn"), upto.alias("to_turn")).where("to_turn > from_turn")
    placed = (
        copies.join(ranges, "source_no").where("turn > from_turn and turn <= to_turn")
        .groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "edge", "edge_part"))).alias("has"))
    )
    if small:  # no more rows than 128 * blocks + n_sources
        out = with_source(rows).join(F.broadcast(placed), ["source_no", "block"], "left")
    else:
        keyed = named.join(placed, ["source_no", "block"], "left").select(F.col("source").alias("_s"), F.col("fine").alias("_f"), "source_no", "source_size", "target", "has")
        out = rows.join(keyed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("fine") == F.col("_f")), "left")
    by_hash = lambda x: F.floor(x["edge_part"] * F.col("size") + unit(F.lit(seed + 4), x["copy"], F.col("id").cast("string")))
    at = lambda x: place(x["copy"], F.col("fine"))
    words = lambda x: F.when(x["edge"].isNull() | (at(x) < x["edge"]), F.col("size")).when(at(x) == x["edge"], by_hash(x)).otherwise(0).cast("long")
    draws = F.transform(F.coalesce("has", F.array().cast("array<struct<copy:int,shard:int,edge:bigint,edge_part:double>>")), lambda x: F.struct(x["shard"].alias("shard"), x["copy"].alias("copy"), words(x).alias("words"), F.xxhash64(F.lit(seed + 2), x["shard"], x["copy"], F.col("id").cast("string")).alias("position")))
    out = out.withColumn("draws", F.filter(draws, lambda x: x["words"] > 0))
    return out.select("row", "id", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"), "draws")


def in_shards(mixed: DataFrame) -> DataFrame:
    """(shard, position, row) of each whole document that mix_sources draws, shard after shard, each in its local shuffled order.

    A draw of a part of a document's words takes the document with that probability, by a hash of id and copy.
    """
    d = mixed.select("row", "id", "size", F.explode("draws").alias("d"))
    d = d.where(unit(F.lit("whole"), F.col("id").cast("string"), F.col("d.copy")) < F.col("d.words") / F.col("size"))
    return d.select("d.shard", "d.position", "row").repartition("shard").sortWithinPartitions("shard", "position")
