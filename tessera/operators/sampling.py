"""Splits and samples in hash order: reruns agree, and so does any other engine with sha256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hash_order
from tessera.operators import profile


def disjoint_split(rows: DataFrame, owner: str, seed: str, share: float, least: int = 11) -> DataFrame:
    """rows with `split`: `share` of the owners with at least `least` rows (one at least, where any is eligible) go to validation, with all their rows."""
    n = rows.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    picked = profile.numbered(n.withColumn("h", hash_order(seed, F.col(owner))), [F.asc("h"), F.asc(owner)], "r")
    picked = picked.join(F.broadcast(picked.agg(F.count("*").alias("m"))))
    picked = picked.where(F.col("r") <= F.least(F.col("m"), F.greatest(F.lit(1), F.round(F.col("m") * share)))).select(owner, F.lit("validation").alias("_s"))
    return rows.join(picked, owner, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


def stratified_split(owners: DataFrame, owner: str, stratum: str, seed: str, val: float, test: float) -> DataFrame:
    """owners with `split`; of each stratum of n: n = 1 stays in train, n = 2 gives one to test, else the rounded shares, with one left for train."""
    w = Window.partitionBy(stratum)
    x = owners.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(hash_order(seed, F.col(owner)))))
    n_test = F.when(F.col("n") == 1, 0).when(F.col("n") == 2, 1).otherwise(F.greatest(F.lit(1), F.round(F.col("n") * test)))
    n_val = F.when(F.col("n") <= 2, 0).otherwise(F.least(F.greatest(F.lit(1), F.round(F.col("n") * val)), F.col("n") - n_test - 1))
    return x.withColumn("split", F.when(F.col("r") <= n_test, "test").when(F.col("r") <= n_test + n_val, "val").otherwise("train")).drop("n", "r")


def capped(rows: DataFrame, owner: str, order: list[Column], least: int, most: int) -> DataFrame:
    """Owners with at least `least` rows, and of each the first `most`."""
    w = Window.partitionBy(owner)
    x = rows.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order)))
    return x.where((F.col("_n") >= least) & (F.col("_r") <= most)).drop("_n", "_r")


def round_robin(rows: DataFrame, owner: str, order: list[Column], n: int) -> DataFrame:
    """n rows, taking one of each owner in turn: by place within the owner, then by owner."""
    x = rows.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    return x.orderBy("_r", owner).limit(n).drop("_r")


def quotas(capacity: DataFrame, owner: str, total: int) -> DataFrame:
    """(owner, quota): `total` shared by the square root of capacity, largest remainders first, never above capacity."""
    roots = capacity.agg(F.sum(F.sqrt("capacity")).alias("roots"))
    x = capacity.join(F.broadcast(roots)).withColumn("share", total * F.sqrt("capacity") / F.col("roots"))
    x = x.withColumn("base", F.least(F.floor("share"), F.col("capacity"))).withColumn("open", F.col("base") < F.col("capacity"))
    x = x.join(F.broadcast(x.agg((F.lit(total) - F.sum("base")).alias("left")))).withColumn("part", F.round(F.col("share") - F.floor("share"), 9))
    x = profile.numbered(x, [F.desc("open"), F.desc("part"), F.asc(owner)], "r")
    return x.select(owner, (F.col("base") + F.when(F.col("open") & (F.col("r") <= F.col("left")), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_pick(rows: DataFrame, owner: str, group: str, key: str, seed: str, quota: DataFrame) -> DataFrame:
    """Of each owner its quota of rows, one of each group in turn, in hash order inside and across groups."""
    inner = F.row_number().over(Window.partitionBy(owner, group).orderBy(hash_order(seed, F.col(key))))
    x = rows.withColumn("_i", inner)
    outer = F.row_number().over(Window.partitionBy(owner).orderBy("_i", hash_order(seed, F.col(owner), F.col(group)), key))
    return x.withColumn("_r", outer).join(quota, owner).where("_r <= quota").drop("_i", "_r", "quota")


def gallery(rows: DataFrame, owner: str, key: str, seed: str, queries: int, others: int, each: int) -> DataFrame:
    """`each` rows of queries + others owners that have so many; the first owners are the queries."""
    n = rows.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") >= each)
    who = profile.numbered(n.withColumn("h", hash_order(seed, F.col(owner))), [F.asc("h"), F.asc(owner)], "r").where(F.col("r") <= queries + others).select(owner, (F.col("r") <= queries).alias("is_query"))
    x = rows.join(who, owner).withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(hash_order(seed, F.col(key))))).where(F.col("_r") <= each).drop("_r")
    return profile.numbered(x, [F.asc(key)], "gallery_index").withColumn("gallery_index", F.col("gallery_index") - 1)


def hash_trials(rows: DataFrame, owner: str, key: str, bin_col: str, seed: int, negatives: int) -> DataFrame:
    """(left, right, label): ordered pairs of one owner in both directions, and for each row `negatives` rows of other owners in its bin.

    The i-th negative of a row stands at place (seed + 17 * row + 31 * i) modulo the bin's other rows.
    """
    x = rows.select(F.col(owner).alias("o"), F.col(key).alias("k"), F.col(bin_col).alias("b"))
    pos = x.alias("l").join(x.alias("r"), (F.col("l.o") == F.col("r.o")) & (F.col("l.k") != F.col("r.k"))).select(F.col("l.k").alias("left"), F.col("r.k").alias("right"), F.lit(1).alias("label"))
    w = Window.partitionBy("b").orderBy("o", "k")
    placed = x.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("b")))
    own = placed.groupBy("b", "o").agg(F.min("at").alias("start"), F.count("*").alias("m"))
    asks = placed.join(own, ["b", "o"]).where("n > m").select("b", F.col("k").alias("left"), "start", "m", "n", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("i"))
    place = F.pmod(F.lit(seed) + 17 * F.col("left") + 31 * F.col("i"), F.col("n") - F.col("m"))
    asks = asks.withColumn("at", F.when(place < F.col("start"), place).otherwise(place + F.col("m")))  # the owner's own rows stand together
    neg = asks.join(placed.select("b", "at", F.col("k").alias("right")), ["b", "at"]).select("left", "right", F.lit(0).alias("label")).distinct()
    return pos.unionByName(neg)


def matched(pool: DataFrame, target: DataFrame, bin_col: str, distance: str, key: str, total: int) -> DataFrame:
    """`total` rows of pool whose bins follow the target's shares: in each bin the nearest, then the nearest of all that are left."""
    share = target.groupBy(bin_col).agg(F.count("*").alias("c")).withColumn("want", F.round(total * F.col("c") / F.sum("c").over(Window.partitionBy()))).select(bin_col, "want")
    x = pool.join(share, bin_col, "left").withColumn("r", F.row_number().over(Window.partitionBy(bin_col).orderBy(distance, key)))
    x = x.withColumn("late", F.when(F.col("r") <= F.coalesce("want", F.lit(0)), 0).otherwise(1))
    return x.orderBy("late", distance, key).limit(total).drop("want", "r", "late")
