"""Evaluation: retrieval, identification, verification, hubness, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import profile


def hits(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """knn with own and their label and `hit`; labels(id, label)."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("own"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("their"))
    return knn.join(a, "src").join(b, "dst").withColumn("hit", (F.col("own") == F.col("their")).cast("int"))


def per_query(knn: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(src, label, p_at_k, hit, recall, ndcg, mrr, first_rank, top1_score); precision divides by k, recall by the smaller of k and
    the other rows of the label, and is 0 without any."""
    near = hits(knn.where(F.col("rank") <= k), labels)
    others = labels.groupBy("label").agg((F.count("*") - 1).alias("positives"))
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    q = near.groupBy("src", F.col("own").alias("label")).agg(
        (F.sum("hit") / F.lit(float(k))).alias("p_at_k"), F.max("hit").alias("hit"), F.sum("hit").alias("found"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.coalesce(first, F.lit(0)).alias("first_rank"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score")
    )
    q = q.join(others, "label").withColumn("most", F.least(F.col("positives"), F.lit(k)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("most"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return q.select("src", "label", "p_at_k", "hit", F.when(F.col("most") > 0, F.col("found") / F.col("most")).otherwise(0.0).alias("recall"), F.when(F.col("most") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.when(F.col("first_rank") > 0, 1 / F.col("first_rank")).otherwise(0.0).alias("mrr"), "first_rank", "top1_score")


def cmc(first_ranks: DataFrame, most: int) -> DataFrame:
    """(rank, identification_rate, miss_rate) for each rank up to `most`; first_ranks(first_rank), 0 for none."""
    n = first_ranks.groupBy(F.when(F.col("first_rank") > 0, F.col("first_rank")).alias("r")).agg(F.count("*").alias("n"))
    ranks = first_ranks.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("rank"))
    total = F.sum("n").over(Window.partitionBy())
    cum = n.select("r", "n", total.alias("total"))
    rate = F.coalesce(F.sum(F.when(F.col("r") <= F.col("rank"), F.col("n"))), F.lit(0)) / F.max("total")
    return ranks.crossJoin(F.broadcast(cum)).groupBy("rank").agg(F.round(rate, 6).alias("identification_rate"), F.round(1 - rate, 6).alias("miss_rate"))


def identification_points(top1: DataFrame, low: float, high: float, points: int) -> DataFrame:
    """Open-set counts and rates at evenly spaced thresholds; top1(mate, correct, score). A few hundred thresholds meet each row."""
    grid = top1.sparkSession.range(points).select(F.col("id").alias("at"), (low + F.col("id") * (high - low) / (points - 1)).alias("threshold"))
    tp = F.count_if(F.col("mate") & F.col("correct") & (F.col("score") >= F.col("threshold")))
    fp = F.count_if(~F.col("mate") & (F.col("score") >= F.col("threshold")))
    out = top1.crossJoin(F.broadcast(grid)).groupBy("at", "threshold").agg(tp.alias("tp"), fp.alias("fp"), F.count_if("mate").alias("mates"), F.count_if(~F.col("mate")).alias("others"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return out.select("at", F.round("threshold", 8).alias("threshold"), "tp", "fp", (F.col("others") - F.col("fp")).alias("tn"), (F.col("mates") - F.col("tp")).alias("fn"), rate(F.col("mates") - F.col("tp"), F.col("mates")).alias("fnir"), rate(F.col("fp"), F.col("others")).alias("fpir"))


def fnir_at_fpir(points: list[tuple[float, float]], target: float) -> float | None:
    """Linear interpolation over (fpir, fnir) pairs; None without points. For the few hundred points of one curve."""
    pts = sorted(points, key=lambda p: p[0])
    if not pts:
        return None
    if target <= pts[0][0]:
        return pts[0][1]
    if target >= pts[-1][0]:
        return pts[-1][1]
    for (x0, y0), (x1, y1) in zip(pts, pts[1:], strict=False):
        if x0 <= target <= x1:
            return y0 if abs(x1 - x0) < 1e-12 else round(y0 + (target - x0) / (x1 - x0) * (y1 - y0), 6)
    return None


def operating_points(trials: DataFrame) -> DataFrame:
    """(threshold, ta, fa, far, frr) at each distinct score, highest first; trials(label, score).

    Equal scores are counted first, so the running sums go over distinct scores, not over trials.
    """
    by = trials.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    total = trials.agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"))
    out = profile.running_sums(by, [F.desc("score")], {"ta": "p", "fa": "n"}).withColumnRenamed("score", "threshold").join(F.broadcast(total))
    return out.select("threshold", "ta", "fa", (F.col("fa") / F.col("negatives")).alias("far"), (1 - F.col("ta") / F.col("positives")).alias("frr"), "positives", "negatives")


def eer(curve: DataFrame) -> DataFrame:
    """One row (eer, threshold): the first point of equal rates; else interpolated at the first change of sign; else the closest."""
    c = profile.numbered(curve.select("threshold", "far", "frr", (F.col("far") - F.col("frr")).alias("d")), [F.desc("threshold")], "at")
    c = c.join(c.select((F.col("at") - 1).alias("at"), F.col("d").alias("d2"), F.col("far").alias("far2"), F.col("threshold").alias("t2")), "at", "left")
    ratio = F.col("d") / (F.col("d") - F.col("d2"))
    exact = F.struct(F.col("far").alias("eer"), F.col("threshold").alias("t"))
    cross = F.struct((F.col("far") + ratio * (F.col("far2") - F.col("far"))).alias("eer"), (F.col("threshold") + ratio * (F.col("t2") - F.col("threshold"))).alias("t"))
    close = F.struct(((F.col("far") + F.col("frr")) / 2).alias("eer"), F.col("threshold").alias("t"))
    pick = c.agg(
        F.max_by(F.when(F.abs("d") <= 1e-12, exact), F.when(F.abs("d") <= 1e-12, F.col("threshold"))).alias("a"),
        F.max_by(F.when(F.col("d") * F.col("d2") < 0, cross), F.when(F.col("d") * F.col("d2") < 0, F.col("threshold"))).alias("b"),
        F.min_by(close, F.struct(F.abs("d"), -F.col("threshold"))).alias("c"),
    )
    best = F.coalesce("a", "b", "c")
    return pick.select(F.round(best["eer"], 6).alias("eer"), F.round(best["t"], 6).alias("threshold"))


def min_dcf(curve: DataFrame, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """One row (min_dcf, threshold): the least normalised detection cost, at the highest threshold that has it."""
    cost = (c_miss * F.col("frr") * p_target + c_fa * F.col("far") * (1 - p_target)) / min(c_miss * p_target, c_fa * (1 - p_target))
    best = F.min(F.struct(F.round(cost, 9).alias("cost"), (-F.col("threshold")).alias("t")))
    return curve.agg(best.alias("x")).select(F.round("x.cost", 6).alias("min_dcf"), F.round(-F.col("x.t"), 6).alias("threshold"))


def probit(p: Column) -> Column:
    """The standard normal quantile, by a rational approximation of relative error below 1.2e-9."""
    # Coefficients of the approximation in the middle and in the tails, highest power first.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for v in coefficients[1:]:
            out = out * x + v
        return out

    tail = lambda q: poly(c, F.sqrt(-2 * F.ln(q))) / poly(d, F.sqrt(-2 * F.ln(q)))
    r = (p - 0.5) * (p - 0.5)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise((p - 0.5) * poly(a, r) / poly(b, r))


def det(curve: DataFrame) -> DataFrame:
    """curve with its rates on the probit scale, clamped to 1e-6."""
    held = lambda n: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(n)))
    return curve.withColumns({"far_probit": probit(held("far")), "frr_probit": probit(held("frr"))})


def downsample(curve: DataFrame, most: int) -> DataFrame:
    """At most `most` rows at even steps of the order by threshold, the first and last among them."""
    c = profile.numbered(curve, [F.desc("threshold")], "at").withColumn("at", F.col("at") - 1)
    c = c.join(F.broadcast(c.agg(F.count("*").alias("n"))))
    step = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(most - 1)))
    return c.where((F.col("n") <= most) | F.array_contains(step, F.col("at").cast("long"))).drop("at", "n")


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, count) of equal width between the extremes, the last bin closed; one bin where all values are equal."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return values.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("count"))


def platt(trials: DataFrame, steps: int = 64, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and offset of a logistic fit to trials(label, score): each step is one pass of five sums and a 2 x 2 solution."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), a * F.col("score") + b))))
        w, e = p * (1 - p), F.col("label") - p
        s = trials.select(w.alias("w"), e.alias("e"), "score").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("score")).alias("wx"), F.sum(F.col("w") * F.col("score") * F.col("score")).alias("wxx"), F.sum("e").alias("e"), F.sum(F.col("e") * F.col("score")).alias("ex")).first()
        h, i, j = s["wxx"] + ridge, s["wx"], s["w"] + ridge
        d = h * j - i * i
        da, db = (j * s["ex"] - i * s["e"]) / d, (h * s["e"] - i * s["ex"]) / d
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def calibration(trials: DataFrame, bins: int) -> DataFrame:
    """(bin, n, mean_score, positive_share) of bins of equal count, bounded at floor(i * n / bins)."""
    t = profile.numbered(trials, [F.asc("score"), F.asc("id")], "at").withColumn("at", F.col("at") - 1)
    t = t.join(F.broadcast(t.agg(F.count("*").alias("n"))))
    upper = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.floor(i * F.col("n") / bins))
    bin_no = F.size(F.filter(upper, lambda u: u <= F.col("at")))
    return t.groupBy(bin_no.cast("long").alias("bin")).agg(F.count("*").alias("n_rows"), F.avg("score").alias("mean_score"), F.avg("label").alias("positive_share"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row (gini): 0 where the total is 0. Equal values are counted first; the running count goes over distinct values."""
    c = values.groupBy(column).agg(F.count("*").alias("m"))
    c = profile.running_sums(c, [F.asc(column)], {"before": "m"}, earlier=True)
    # ranks before+1 .. before+m share one value
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2
    s = c.agg(F.sum(ranks * F.col(column)).alias("ix"), F.sum(F.col("m") * F.col(column)).alias("x"), F.sum("m").alias("n"))
    return s.select(F.round(F.when(F.col("x") > 0, 2 * F.col("ix") / (F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0), 8).alias("gini"))


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Correlation of ordinal ranks; ties by key."""
    r = profile.numbered(profile.numbered(df.select(x, y, key), [F.asc(x), F.asc(key)], "rx"), [F.asc(y), F.asc(key)], "ry")
    return r.agg(F.round(F.corr("rx", "ry"), 8).alias("spearman"))


def agreement(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(src, overlap, same_cells, same_order, same_set, same_top1) of two rankings."""
    a = left.where(F.col("rank") <= k).select("src", "dst", F.col("rank").alias("ra"))
    b = right.where(F.col("rank") <= k).select("src", "dst", F.col("rank").alias("rb"))
    j = a.join(b, ["src", "dst"], "full").groupBy("src").agg(F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("overlap"), F.count_if(F.col("ra") == F.col("rb")).alias("same_cells"), F.count_if((F.col("ra") == 1) & (F.col("rb") == 1)).alias("same_top1"))
    return j.select("src", "overlap", "same_cells", (F.col("same_cells") == k).alias("same_order"), (F.col("overlap") == k).alias("same_set"), (F.col("same_top1") == 1).alias("same_top1"))


def purity(clusters: DataFrame) -> DataFrame:
    """One row: pairs of one cluster and label over pairs of one cluster; clusters(cluster, label)."""
    pairs = lambda n: n * (n - 1) / 2
    cells = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    both = cells.groupBy("cluster").agg(F.sum(pairs(F.col("n"))).alias("good"), pairs(F.sum("n")).alias("all"))
    return both.agg(F.round(F.sum("good") / F.nullif(F.sum("all"), F.lit(0.0)), 8).alias("purity"))
