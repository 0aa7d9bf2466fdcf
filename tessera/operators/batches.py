"""Speaker-balanced training batches: each epoch a keyed permutation that can begin at any batch without sorting the table."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import numbered
from tessera.operators.skew import with_group
from tessera.sources.lineage import cut

#: Numbers below this prime have products below 2**62.
PRIME = 2_147_483_647
#: Rounds of the shuffle: about six for each bit of a short list, and enough for long ones to look random.
ROUNDS = 24


def mixed(x: Column) -> Column:
    """A number below PRIME for one that is not negative; squaring makes it depend on x in no line."""
    return (x % PRIME * (x % PRIME) % PRIME * 48_271 + 11) % PRIME


def key_of(*parts: Column | int) -> Column:
    """A number below PRIME for a list of numbers: the first 32 bits of the sha256 of the parts, joined by colons."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % PRIME


def shuffled(x: Column, n: Column, key: Column) -> Column:
    """Where place x of 0..n-1 goes in the order that `key` names: the swap-or-not shuffle of Hoang, Morris and Rogaway (2012).

    Each round pairs every place with another one, x with (k - x) mod n, and swaps a pair or not by a bit that both share.
    """

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), x.cast("long"), lambda x, r: swapped(x, partner(x, n, key, r), key, r))


def partner(x: Column, n: Column, key: Column, r: Column | int) -> Column:
    return (mixed(key + r * 7_919) % n - x + n) % n


def swapped(x: Column, other: Column, key: Column, r: Column | int) -> Column:
    bit = F.shiftright(mixed(F.greatest(x, other) % PRIME * 69_621 + key + r * 104_729), 7) % 2
    return F.when(bit == 1, other).otherwise(x)


def with_shuffled(df: DataFrame, name: str, x: Column, n: Column, key: Column) -> DataFrame:
    """df with `name`, shuffled(x, n, key), for many rows: key and places are columns, a projection or two for each round.

    An expression in a function of arrays is interpreted, and computed as often as it is named: the sha256 of the key eight times a
    round. Here it is computed once, and the rounds are compiled. The rows are written once, since planning a join on top of so many
    projections takes minutes.
    """
    df = df.withColumns({"_x": x.cast("long"), "_m": n.cast("long"), "_key": key})
    for r in range(ROUNDS):
        df = df.withColumn("_other", partner(F.col("_x"), F.col("_m"), F.col("_key"), r)).withColumn("_x", swapped(F.col("_x"), F.col("_other"), F.col("_key"), r))
    return cut(df.withColumn(name, F.col("_x")).drop("_x", "_m", "_key", "_other"))


@dataclass(frozen=True)
class Balanced:
    """What batches are drawn from: owners(domain, at, owner, rows), rows(domain, at, place, key), the owners of each domain, and all rows."""

    owners: DataFrame
    rows: DataFrame
    sizes: dict[int, int]
    total: int


def balanced(rows: DataFrame, owner: str, key: str, external: Column | None = None) -> Balanced:
    """Number the owners of each domain (0, or 1 for owners with any `external` row) and the rows of each owner, once for all epochs.

    Rows are numbered by ranges of (owner, key) and owners by ranges of (domain, owner), so that an owner with very many rows is many ranges.
    """
    flag = F.max((F.lit(False) if external is None else F.coalesce(external, F.lit(False))).cast("int"))
    known = rows.where(F.col(owner).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(owner).agg(F.count("*").alias("rows"), flag.alias("domain"))
    owners = numbered(counts, [F.asc("domain"), F.asc(owner)], "_number")
    first = owners.groupBy("domain").agg(F.min("_number").alias("_first"), F.count("*").alias("_n"))
    sizes = {r["domain"]: r["_n"] for r in first.collect()}  # two rows
    owners = cut(owners.join(F.broadcast(first), "domain").select("domain", (F.col("_number") - F.col("_first")).alias("at"), F.col(owner).alias("owner"), "rows"))
    placed = numbered(known.select(F.col(owner).alias("owner"), F.col(key).alias("key")), [F.asc("owner"), F.asc("key")], "_number")
    begin = placed.groupBy("owner").agg(F.min("_number").alias("_first"))
    total = owners.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    placed = with_group(placed, cut(begin.join(owners, "owner")), "owner", "rows", total).select("domain", "at", (F.col("_number") - F.col("_first")).alias("place"), "key")
    return Balanced(owners, cut(placed), sizes, total)


def external_slots(batch_size: int, share: float | None) -> int:
    """How many rows of a batch come from the external domain; one at least of each domain that has a share."""
    if share is None or share <= 0:
        return 0
    if not share <= 1:
        raise ValueError("the external share must lie in 0..1")
    wanted = int(batch_size * share + 0.5)
    return batch_size if share == 1 else min(max(1, wanted), max(1, batch_size - 1))


def batches(table: Balanced, batch_size: int, seed: int, epoch: int, first: int, last: int, share: float | None = None, crop: tuple[float, float] = (2.0, 4.0)) -> DataFrame:
    """(epoch, batch, slot, domain, owner, key, crop_seconds, request_seed) of the batches first .. last - 1 of an epoch.

    The slots of all batches in turn go through the owners in the epoch's order, again and again, so a batch holds no owner twice while
    there are owners enough; each visit takes the owner's next row in an order of its own, newly shuffled once all are used.
    With `share`, so much of each batch goes through the external owners and the rest through the others; without it, all are one
    domain. A slot is a function of its number: only the batches asked for are made, by two joins of their rows.
    """
    if share is not None and not {0, 1} <= set(table.sizes):
        raise ValueError("a domain share needs owners of both domains")
    if not table.total:
        raise ValueError("no rows to draw from")
    spark, none = table.owners.sparkSession, F.lit(0).cast("long")
    outer = external_slots(batch_size, share)
    slots = spark.range(first * batch_size, max(first, last) * batch_size).select(F.floor(F.col("id") / batch_size).alias("batch"), (F.col("id") % batch_size).alias("slot"))
    if share is None:  # external owners follow the others
        n_base = table.sizes.get(0, 0)
        n = F.lit(sum(table.sizes.values())).cast("long")
        drawn = slots.select("batch", "slot", (F.col("batch") * batch_size + F.col("slot")).alias("_p"), n.alias("_n"), none.alias("_d"))
        drawn = with_shuffled(drawn, "_at", F.col("_p") % F.col("_n"), F.col("_n"), key_of(seed, epoch, F.col("_d"))).select("batch", "slot", "_p", "_n", (F.col("_at") >= n_base).cast("int").alias("domain"), F.when(F.col("_at") >= n_base, F.col("_at") - n_base).otherwise(F.col("_at")).alias("at"))
    else:
        inner = batch_size - outer
        from_outer = F.col("slot") >= inner
        p = F.when(from_outer, F.col("batch") * outer + F.col("slot") - inner).otherwise(F.col("batch") * inner + F.col("slot"))
        n = F.when(from_outer, F.lit(table.sizes[1])).otherwise(F.lit(table.sizes[0])).cast("long")
        drawn = slots.select("batch", "slot", p.alias("_p"), n.alias("_n"), from_outer.cast("int").alias("domain"))
        drawn = with_shuffled(drawn, "at", F.col("_p") % F.col("_n"), F.col("_n"), key_of(seed, epoch, F.col("domain")))
    visit = F.floor(F.col("_p") / F.col("_n"))
    drawn = drawn.withColumn("_visit", visit).join(table.owners, ["domain", "at"])
    turn = F.floor(F.col("_visit") / F.col("rows"))
    drawn = with_shuffled(drawn, "place", F.col("_visit") % F.col("rows"), F.col("rows"), key_of(seed, epoch, F.col("domain") + 2, F.col("at"), turn))
    low, high = crop
    seconds = F.round(low + (high - low) * key_of(seed, epoch, 5, F.col("batch")) / PRIME, 6)
    return drawn.join(table.rows, ["domain", "at", "place"]).select(F.lit(epoch).cast("long").alias("epoch"), "batch", "slot", F.col("domain").cast("long").alias("domain"), "owner", "key", seconds.alias("crop_seconds"), key_of(seed, epoch, F.col("batch"), F.col("slot")).alias("request_seed"))


@dataclass(frozen=True)
class Progress:
    """Where a sampler stands: the next batch of an epoch. `asdict` and `Progress(**state)` store and restore it."""

    epoch: int = 0
    next_batch: int = 0

    def state(self) -> dict[str, int]:
        return asdict(self)

    def take(self, n: int, per_epoch: int) -> tuple[list[tuple[int, int, int]], Progress]:
        """The next n batches as (epoch, first, last) runs, and where the sampler stands after them."""
        if n < 0 or per_epoch < 1 or not 0 <= self.next_batch <= per_epoch:
            raise ValueError("n must not be negative, and the state must lie in its epoch")
        runs, epoch, at = [], self.epoch, self.next_batch
        while n:
            if at == per_epoch:
                epoch, at = epoch + 1, 0
            end = min(per_epoch, at + n)
            runs.append((epoch, at, end))
            n, at = n - (end - at), end
        return runs, Progress(epoch, at)


def taken(table: Balanced, batch_size: int, seed: int, progress: Progress, n: int, per_epoch: int | None = None, **kw) -> tuple[DataFrame, Progress]:
    """The next n batches after `progress`, over as many epochs as they need, and the state to store once they are used."""
    per_epoch = per_epoch or max(1, -(-table.total // batch_size))
    runs, after = progress.take(n, per_epoch)
    out = None
    for epoch, first, last in runs or [(progress.epoch, 0, 0)]:
        part = batches(table, batch_size, seed, epoch, first, last, **kw)
        out = part if out is None else out.unionByName(part)
    return out, after
