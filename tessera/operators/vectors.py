"""Vector search and scoring: exact cosine top-k in blocks, score tables, pooling, class posteriors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dot, norm, unit_vector

BLOCK = 16_384
#: Rows of a block of queries that are multiplied at a time, and columns of which the greatest score is found first.
SLICE, STRIP = 128, 64


def beside(held: DataFrame, streamed: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """(part, held, id, v): held rows dealt to blocks of about `block` by a hash of the id, a partition for each; all streamed rows come
    behind each block. So held rows are shuffled once and streamed rows once for each block."""
    element = "float" if held.schema[vector_col].dataType.simpleString() == streamed.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    n = held.count()
    parts = min(20_000, max(-(-n // block), min(12, -(-n // 2048)), 1))
    own = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    a = own(held).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("held"), "id", "v")
    b = own(streamed).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("held"), "id", "v")
    return a.unionByName(b).repartitionById(parts, "part").sortWithinPartitions(F.desc("held"))


def met(batches: Iterator[pa.RecordBatch], block: int, unit: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and vectors of a partition's held rows and of its streamed ones, the latter about `block` (at least a batch) at a time; vectors have
    equal lengths, and `unit` brings them to length one."""
    held, rest, x, y, n = [], [], None, None, 0

    def joined(side: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([ids for ids, _ in side]), unit(np.concatenate([v for _, v in side]))

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, first = batch.column("id").to_numpy(zero_copy_only=False), int(batch.column("held").to_numpy(zero_copy_only=False).sum())
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        if first:
            held.append((ids[:first], v[:first]))
        if first < len(ids) and held:
            rest.append((ids[first:], v[first:]))
            n += len(ids) - first
        if n >= block:
            x, (y, rest, n) = x or joined(held), (joined(rest), [], 0)
            yield *x, *y
    if n:
        yield *(x or joined(held)), *joined(rest)


def best_of(x: np.ndarray, y: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, score) of the k greatest products of each row with rows of another id; of equal ones the smaller id. What lies
    below a row's `least` may be left out.

    Products in single precision find what may be among them: k strips of columns have a score that reaches the k-th greatest of
    the strips' maxima (of the scores themselves, where there are fewer strips), so what lies below it by more than the rounding is out. The others are computed again in double precision.
    """
    wide = -(-len(y) // STRIP) * STRIP
    right = np.zeros((wide, y.shape[1]), np.float32)
    right[: len(y)] = y
    left, slack, out = x.astype(np.float32), 2e-7 * y.shape[1] + 1e-6, []
    for a in range(0, len(x), SLICE):
        s = left[a : a + SLICE] @ right.T
        s[:, len(y) :] = -np.inf
        at = np.searchsorted(ids, own[a : a + SLICE])
        same = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own[a : a + SLICE]))
        s[same, at[same]] = -np.inf
        top = s.reshape(len(s), -1, STRIP).max(axis=2) if k <= wide // STRIP else s[:, : len(y)]
        bound = np.partition(top, -k, axis=1)[:, -k] if k <= top.shape[1] else np.full(len(s), -np.inf)
        if least is not None:
            bound = np.maximum(bound, least[a : a + SLICE])
        r, c = np.nonzero(s >= np.maximum(bound - slack, -4.0)[:, None])
        exact = np.einsum("ij,ij->i", x[a + r], y[c])
        order = np.lexsort((c, -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = (place < k) & (ids[c] != own[a + r])
        out.append((a + r[keep], c[keep], exact[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def knn(queries: DataFrame, k: int, gallery: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Exact cosine top-k: (src, dst, rank from 1, score), ordered by score, then smaller dst; a row is no neighbour of itself.

    Queries are dealt to blocks of about `block` rows, one task each, and the gallery streams through every task, which keeps k for each
    of its queries: no candidates are shuffled. Nothing is broadcast and no task holds more than two blocks and its queries' best, so
    any size works; the products are all pairs, which exact search needs.
    """
    both = beside(queries, queries if gallery is None else gallery, id_col, vector_col, block)

    def unit(m: np.ndarray) -> np.ndarray:
        m /= np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-12)[:, None]  # in place, and without a second table of squares
        return m

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, least = None, None
        for own, x, ids, y in met(batches, block, unit):
            order = np.argsort(ids, kind="stable")
            ids, y = ids[order], y[order]
            r, c, score = best_of(x, y, own, ids, k, least)
            near = (r, ids[c], score) if near is None else firsts(*map(np.concatenate, zip(near, (r, ids[c], score), strict=True)), k)[:3]
            full = np.flatnonzero(np.bincount(near[0], minlength=len(own)) >= k)
            least = np.full(len(own), -np.inf)
            least[full] = near[2][np.searchsorted(near[0], full, "right") - 1]
        if near is not None:
            src, dst, score, place = firsts(own[near[0]], *near[1:], k)
            yield pa.RecordBatch.from_pydict({"src": src, "dst": dst, "rank": (place + 1).astype(np.int32), "score": score})

    return both.select("held", "id", "v").mapInArrow(best, "src long, dst long, rank int, score double")


def firsts(of: np.ndarray, dst: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """of, dst, score and place (from 0) of the k greatest scores of each `of`, in its order; of equal ones the smaller dst."""
    order = np.lexsort((dst, -score, of))
    of, dst, score = of[order], dst[order], score[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    keep = place < k
    return of[keep], dst[keep], score[keep], place[keep]


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; null where a vector has no length."""
    raw = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def in_blocks(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None, block: int = 2048) -> DataFrame:
    """Each row of left beside each row of right. Both are dealt to blocks, by a hash of their key (of all columns without one), that
    meet pair by pair, in as many partitions as there are pairs of blocks: their rows are few for Spark to merge, their pairs are not."""
    n_l, n_r = (max(1, -(-df.count() // block)) for df in (left, right))
    parts = min(n_l * n_r, 20_000)

    def placed(df: DataFrame, columns: list, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        out = df.withColumn(own, F.pmod(F.xxhash64(*columns), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return out.repartition(parts, "_l", "_r")

    a, b = placed(left, [left_key], "_l", n_l, "_r", n_r), placed(right, [right_key] if right_key else right.columns, "_r", n_r, "_l", n_l)
    return a.join(b, ["_l", "_r"]).drop("_l", "_r")


def every_pair(left: DataFrame, right: DataFrame, key: str, most: int = 10_000, block: int = 2048) -> DataFrame:
    """Each row of left beside each row of right. A right side of at most `most` rows is broadcast; else both are dealt to blocks that
    meet pair by pair, left rows by a hash of `key`."""
    n = right.limit(most + 1).count()
    if n <= most:
        return left.crossJoin(F.broadcast(right))
    return in_blocks(left, right, key, None, block)


def score_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, score) of (id, v) tables: every left row against every right row, a stated and small query set."""
    a = left.select(F.col("id").alias("left_id"), F.col("v").alias("a"))
    b = right.select(F.col("id").alias("right_id"), F.col("v").alias("b"))
    return every_pair(a, b, "left_id").select("left_id", "right_id", cosine(F.col("a"), F.col("b")).alias("score"))


def score_blocks(queries: DataFrame, gallery: DataFrame, block: int = 512) -> DataFrame:
    """(left_id, right_id, score) of (id, v) tables: every query against every other row of the gallery, whatever its size.

    The gallery is dealt to blocks as knn's queries are, and the queries stream through them; `block` rows of either are multiplied at a
    time and nothing is broadcast. score lies in [-1, 1], null where a vector has no length.
    """
    both = beside(gallery, queries, "id", "v", BLOCK)

    def unit(m: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, own, x in met(batches, block, unit):
            for a in range(0, len(own), block):
                for b in range(0, len(ids), block):
                    score = np.clip(x[a : a + block] @ y[b : b + block].T, -1, 1)
                    left, right = np.repeat(own[a : a + block], score.shape[1]), np.tile(ids[b : b + block], score.shape[0])
                    keep = left != right
                    yield pa.RecordBatch.from_pydict({"left_id": left[keep], "right_id": right[keep], "score": score.ravel()[keep]})

    found = both.select("held", "id", "v").mapInArrow(scores, "left_id long, right_id long, score double")
    return found.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def pair_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(left_id, right_id, ...) with `score`; null where an id is unknown."""
    a = vectors.select(F.col("id").alias("left_id"), F.col("v").alias("_a"))
    b = vectors.select(F.col("id").alias("right_id"), F.col("v").alias("_b"))
    return pairs.join(a, "left_id", "left").join(b, "right_id", "left").withColumn("score", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def top_of(scores: DataFrame, k: int) -> DataFrame:
    """The k best right rows of each left row, with rank."""
    w = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pooled(vectors: DataFrame, owner: str, vector: str = "v", first_unit: bool = True, last_unit: bool = True, how: str = "avg") -> DataFrame:
    """(owner, n, v): the mean (or maximum) of each owner's vectors, element by element, with map-side combination.

    Vectors are brought to length one before and after where asked for.
    """
    v = unit_vector(F.col(vector)) if first_unit else F.col(vector).cast("array<double>")
    cells = vectors.select(owner, F.posexplode(v).alias("pos", "x")).groupBy(owner, "pos").agg((F.avg("x") if how == "avg" else F.max("x")).alias("x"), F.count("*").alias("n"))
    out = cells.groupBy(owner).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return out.withColumn("v", unit_vector(F.col("v"))) if last_unit else out


def class_posteriors(vectors: DataFrame, label: str, top: int, scale: float = 10.0) -> DataFrame:
    """(id, class_rank from 1, class_id, prob): softmax of scale * cosine to each label's centroid, the best `top` classes.

    The centroids are one row for each label; they meet each vector once.
    """
    centres = pooled(vectors, label).select(F.col(label).alias("class_id"), F.col("v").alias("c"))
    s = every_pair(vectors.select("id", "v"), centres, "id").select("id", "class_id", (scale * cosine(F.col("v"), F.col("c"))).alias("s"))
    w = Window.partitionBy("id")
    p = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("prob", F.col("e") / F.sum("e").over(w))
    order = w.orderBy(F.desc("prob"), "class_id")
    return p.withColumn("class_rank", F.row_number().over(order)).where(F.col("class_rank") <= top).select("id", "class_rank", "class_id", "prob")


def verify(trials: DataFrame, enrolled: DataFrame, probes: DataFrame, threshold: float) -> DataFrame:
    """trials(owner, id) with the cosine of the owner's pooled vector to the probe, and whether it is accepted."""
    e = enrolled.select("owner", F.col("v").alias("_e"))
    p = probes.select("id", F.col("v").alias("_p"))
    out = trials.join(e, "owner").join(p, "id").withColumn("score", cosine(F.col("_e"), F.col("_p"))).drop("_e", "_p")
    return out.withColumn("accepted", F.col("score") >= threshold)
