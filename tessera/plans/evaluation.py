"""Queries that evaluate rankings and scores, split and sample owners, and count events over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics, sampling, select, signal, vectors as x
from tessera.plans.base import KNN, VECTORS, knn, nodes, query, r6, read, vectors
from tessera.streaming import jobs

HITS = f"{KNN(10)}, h AS (SELECT src, a.label AS own, rank, score, (a.label = b.label)::INT AS hit FROM knn JOIN v a ON a.id = src JOIN v b ON b.id = dst)"
PER = f"{HITS}, pos AS (SELECT label, count(*) - 1 AS positives FROM v GROUP BY 1), q AS (SELECT src, sum(hit) AS found, coalesce(min(rank) FILTER (hit = 1), 0) AS first_rank, sum(hit / log2(rank + 1)) AS dcg, least(any_value(positives), 10) AS most FROM h JOIN pos ON pos.label = own GROUP BY 1)"
TRIALS = f"{VECTORS}, t AS (SELECT a.id * 10 + o AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score, (a.label = b.label)::INT AS label FROM v a CROSS JOIN (SELECT unnest(range(1, 6)) AS o) JOIN v b ON b.id = a.id + o)"
CURVE = f"{TRIALS}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM t GROUP BY 1), tot AS (SELECT sum(label) AS pos, sum(1 - label) AS neg FROM t), curve AS (SELECT score AS threshold, sum(p) OVER w AS ta, sum(n) OVER w AS fa, sum(n) OVER w / neg AS far, 1 - sum(p) OVER w / pos AS frr FROM g, tot WINDOW w AS (ORDER BY score DESC))"


def per_query(spark, d):
    return metrics.per_query(knn(spark, d, 10), nodes(spark, d), 10)


def trials(spark, d):
    """(id, score, label): each vector against the five after it."""
    v = vectors(spark, d)
    pairs = v.select(F.col("id").alias("left_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("o")).withColumn("right_id", F.col("left_id") + F.col("o"))
    scored = x.pair_scores(pairs, v).where("score is not null")
    a, b = v.select(F.col("id").alias("left_id"), F.col("label").alias("la")), v.select(F.col("id").alias("right_id"), F.col("label").alias("lb"))
    return scored.join(a, "left_id").join(b, "right_id").select((F.col("left_id") * 10 + F.col("o")).alias("id"), r6("score"), (F.col("la") == F.col("lb")).cast("int").alias("label"))


def curve(spark, d):
    return metrics.operating_points(trials(spark, d))


@query("m1_precision", f"WITH {PER} SELECT src, round(found / 10, 6) AS p_at_k, first_rank FROM q")
def m1(spark, d):
    return per_query(spark, d).select("src", r6("p_at_k"), F.col("first_rank").cast("long").alias("first_rank"))


@query("m2_rank_metrics", f"WITH {PER}, i AS (SELECT n, sum(1 / log2(k + 1)) AS ideal FROM (SELECT unnest(range(1, 11)) AS n) JOIN (SELECT unnest(range(1, 11)) AS k) ON k <= n GROUP BY 1) SELECT src, round(coalesce(found / most, 0), 6) AS recall, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(CASE WHEN first_rank > 0 THEN 1 / first_rank ELSE 0 END, 6) AS mrr FROM q LEFT JOIN i ON i.n = most")
def m2(spark, d):
    return per_query(spark, d).select("src", r6("recall"), r6("ndcg"), r6("mrr"))


@query("m5_cmc", f"WITH {PER} SELECT r AS rank, round(count(*) FILTER (first_rank BETWEEN 1 AND r) / count(*), 6) AS identification_rate FROM q, (SELECT unnest(range(1, 11)) AS r) GROUP BY 1")
def m5(spark, d):
    return metrics.cmc(per_query(spark, d), 10).select(F.col("rank").cast("long").alias("rank"), "identification_rate")


@query("m6_identification", f"WITH {HITS}, t AS (SELECT src % 4 <> 0 AS mate, hit = 1 AS correct, score FROM h WHERE rank = 1) SELECT i AS at, count(*) FILTER (mate AND correct AND score >= i / 10e0) AS tp, count(*) FILTER (NOT mate AND score >= i / 10e0) AS fp FROM t, (SELECT unnest(range(0, 11)) AS i) GROUP BY 1")
def m6(spark, d):
    h = metrics.hits(knn(spark, d, 10).where("rank = 1"), nodes(spark, d))
    top = h.select((F.col("src") % 4 != 0).alias("mate"), (F.col("hit") == 1).alias("correct"), "score")
    return metrics.identification_points(top, 0.0, 1.0, 11).select("at", "tp", "fp")


@query("m9_operating_points", f"WITH {CURVE} SELECT threshold, ta::BIGINT AS ta, fa::BIGINT AS fa, round(far, 6) AS far, round(frr, 6) AS frr FROM curve")
def m9(spark, d):
    return curve(spark, d).select("threshold", "ta", "fa", r6("far"), r6("frr"))


@query("m10_eer")
def m10(spark, d):
    return metrics.eer(curve(spark, d))


@query("m11_min_dcf", f"WITH {CURVE} SELECT round(min(c), 6) AS min_dcf, round(arg_min(threshold, (c, -threshold)), 6) AS threshold FROM (SELECT threshold, round((frr * 0.01 + far * 0.99) / 0.01, 9) AS c FROM curve)")
def m11(spark, d):
    return metrics.min_dcf(curve(spark, d))


def PROBIT(p: str) -> str:
    a = ("-39.69683028665376", "220.9460984245205", "-275.9285104469687", "138.3577518672690", "-30.66479806614716", "2.506628277459239")
    b = ("-54.47609879822406", "161.5858368580409", "-155.6989798598866", "66.80131188771972", "-13.28068155288572", "1.0")
    c = ("-0.007784894002430293", "-0.3223964580411365", "-2.400758277161838", "-2.549732539343734", "4.374664141464968", "2.938163982698783")
    d = ("0.007784695709041462", "0.3224671290700398", "2.445134137142996", "3.754408661907416", "1.0")

    def poly(coefficients: tuple[str, ...], x: str) -> str:
        out = f"{coefficients[0]}::DOUBLE"
        for v in coefficients[1:]:
            out = f"(({out}) * {x} + {v}::DOUBLE)"
        return out

    tail = lambda q: f"{poly(c, f'sqrt(-2 * ln({q}))')} / {poly(d, f'sqrt(-2 * ln({q}))')}"
    r = f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    return f"round(CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -({tail(f'(1 - {p})')}) ELSE ({p} - 0.5::DOUBLE) * {poly(a, r)} / {poly(b, r)} END, 6)"


@query("m12_det", f"WITH {CURVE}, h AS (SELECT threshold, greatest(1e-6, least(1 - 1e-6, far)) AS f, greatest(1e-6, least(1 - 1e-6, frr)) AS g FROM curve) SELECT threshold, {PROBIT('f')} AS far_probit, {PROBIT('g')} AS frr_probit FROM h")
def m12(spark, d):
    return metrics.det(curve(spark, d)).select("threshold", r6("far_probit"), r6("frr_probit"))


@query("m13_score_stats", f"WITH {TRIALS} SELECT round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS deviation, round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) AS gap FROM t")
def m13(spark, d):
    same = lambda v: F.avg(F.when(F.col("label") == v, F.col("score")))
    return trials(spark, d).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("deviation"), F.round(same(1) - same(0), 6).alias("gap"))


@query("m14_histogram", f"WITH {TRIALS}, e AS (SELECT min(score) AS l, max(score) AS h FROM t) SELECT least(floor((score - l) / ((h - l) / 20)), 19)::BIGINT AS bin, count(*) AS count FROM t, e GROUP BY 1")
def m14(spark, d):
    return metrics.histogram(trials(spark, d), "score", 20)


@query("m15_platt")
def m15(spark, d):
    a, b = metrics.platt(trials(spark, d))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "slope double, offset double")


@query("m16_calibration", f"WITH {TRIALS}, o AS (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS place, count(*) OVER () AS n FROM t) SELECT (SELECT count(*) FROM (SELECT unnest(range(1, 11)) AS i) WHERE floor(i * n / 10) <= place) AS bin, count(*) AS n_rows, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_share FROM o GROUP BY 1")
def m16(spark, d):
    return metrics.calibration(trials(spark, d), 10).select("bin", "n_rows", r6("mean_score"), r6("positive_share"))


@query("m17_gini", f"WITH {KNN(10)}, g AS (SELECT v.id, count(k.src) AS x FROM v LEFT JOIN knn k ON k.dst = v.id GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x, id) AS i, count(*) OVER () AS n FROM g) SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 8) AS gini FROM r")
def m17(spark, d):
    from tessera.operators.graph import in_degree

    return metrics.gini(in_degree(knn(spark, d, 10), nodes(spark, d), 10), "in_degree")


@query("m19_spearman", "WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS b FROM orders) SELECT round(corr(a, b), 8) AS spearman FROM r")
def m19(spark, d):
    return metrics.spearman(read(spark, d, "orders"), "o_totalprice", "o_orderdate", "o_orderkey")


@query("m24_purity", f"WITH {VECTORS}, c AS (SELECT id % 7 AS cluster, label, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1) / 2) AS good, sum(n) * (sum(n) - 1) / 2 AS every FROM c GROUP BY cluster) SELECT round(sum(good) / sum(every), 8) AS purity FROM b")
def m24(spark, d):
    return metrics.purity(nodes(spark, d).select((F.col("id") % 7).alias("cluster"), "label"))


OWNERS = "own AS (SELECT o_custkey AS owner, count(*) AS n, sha256('s|' || o_custkey) AS h FROM orders GROUP BY 1)"


@query("n1_disjoint_split", f"WITH {OWNERS}, e AS (SELECT owner, row_number() OVER (ORDER BY h) AS r, count(*) OVER () AS m FROM own WHERE n >= 11), p AS (SELECT owner FROM e WHERE r <= least(m, greatest(1, round(m * 0.2)))) SELECT o_orderkey, CASE WHEN owner IS NULL THEN 'train' ELSE 'validation' END AS split FROM orders LEFT JOIN p ON owner = o_custkey")
def n1(spark, d):
    return sampling.disjoint_split(read(spark, d, "orders"), "o_custkey", "s", 0.2).select("o_orderkey", "split")


@query("n9_capped", "SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE n >= 5 AND r <= 8")
def n9(spark, d):
    return sampling.capped(read(spark, d, "orders"), "o_custkey", [F.col("o_orderkey")], 5, 8).select("o_orderkey")


@query("n10_round_robin", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ORDER BY r, o_custkey LIMIT 500")
def n10(spark, d):
    return sampling.round_robin(read(spark, d, "orders"), "o_custkey", [F.col("o_orderkey")], 500).select("o_orderkey")


@query("n3_gallery", f"WITH {OWNERS}, w AS (SELECT owner, row_number() OVER (ORDER BY h) AS r FROM own WHERE n >= 4), g AS (SELECT o_orderkey, r <= 10 AS is_query, row_number() OVER (PARTITION BY owner ORDER BY sha256('s|' || o_orderkey)) AS k FROM orders JOIN w ON owner = o_custkey WHERE r <= 30) SELECT o_orderkey, is_query FROM g WHERE k <= 4")
def n3(spark, d):
    return sampling.gallery(read(spark, d, "orders"), "o_custkey", "o_orderkey", "s", 10, 20, 4).select("o_orderkey", "is_query")


QUOTA = "cap AS (SELECT o_custkey, count(*) AS capacity FROM orders GROUP BY 1), sh AS (SELECT *, 500 * sqrt(capacity) / sum(sqrt(capacity)) OVER () AS share FROM cap), ba AS (SELECT *, least(floor(share), capacity)::BIGINT AS base FROM sh), pl AS (SELECT *, 500 - sum(base) OVER () AS spare, row_number() OVER (ORDER BY base < capacity DESC, round(share - floor(share), 9) DESC, o_custkey) AS r FROM ba), quota AS (SELECT o_custkey, base + (base < capacity AND r <= spare)::BIGINT AS quota FROM pl)"


def order_quotas(spark, d):
    """(o_custkey, quota): 500 orders shared by the square root of each customer's number of orders."""
    return sampling.quotas(read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("capacity")), "o_custkey", 500)


@query("n11_quotas", f"WITH {QUOTA} SELECT * FROM quota")
def n11(spark, d):
    return order_quotas(spark, d)


@query("n12_stratified_pick", f"WITH {QUOTA}, i AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY sha256('s|' || o_orderkey)) AS i FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY i, sha256('s|' || o_custkey || '|' || o_orderpriority), o_orderkey) AS k FROM i) SELECT o_orderkey FROM o JOIN quota USING (o_custkey) WHERE k <= quota")
def n12(spark, d):
    return sampling.stratified_pick(read(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", "s", order_quotas(spark, d)).select("o_orderkey")


@query("n13_hash_trials", "WITH x AS (SELECT o_custkey AS o, o_orderkey AS k, o_orderdate::DATE AS b FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o, k) - 1 AS place, count(*) OVER (PARTITION BY b) AS n, count(*) OVER (PARTITION BY b, o) AS m FROM x), f AS (SELECT l.k AS q, l.b, r.k, row_number() OVER (PARTITION BY l.k ORDER BY r.place) - 1 AS place FROM p l JOIN p r ON l.b = r.b AND l.o <> r.o), a AS (SELECT DISTINCT k AS q, (7 + 17 * k + 31 * i) % (n - m) AS place FROM p, range(0, 2) t(i) WHERE n > m) SELECT l.k AS \"left\", r.k AS \"right\", 1 AS label FROM x l JOIN x r ON l.o = r.o AND l.k <> r.k UNION ALL SELECT q, f.k, 0 FROM a JOIN f USING (q, place)")
def n13(spark, d):
    return sampling.hash_trials(read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "o_orderkey", "day", 7, 2)


@query("n14_matched", "WITH o AS (SELECT o_orderkey, o_orderpriority, month(o_orderdate) AS bin, round(abs(o_totalprice - 150000), 2) AS distance FROM orders), s AS (SELECT bin, round(300 * count(*) / sum(count(*)) OVER ()) AS want FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY 1), r AS (SELECT o.*, want, row_number() OVER (PARTITION BY bin ORDER BY distance, o_orderkey) AS r FROM o LEFT JOIN s USING (bin) WHERE o_orderpriority <> '1-URGENT') SELECT o_orderkey, bin, distance FROM r ORDER BY r > coalesce(want, 0), distance, o_orderkey LIMIT 300")
def n14(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.month("o_orderdate").alias("bin"), F.round(F.abs(F.col("o_totalprice") - 150000), 2).alias("distance"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return sampling.matched(o.where(~urgent), o.where(urgent), "bin", "distance", "o_orderkey", 300).select("o_orderkey", "bin", "distance")


@query("n15_cohort", "WITH c AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_orderkey FROM c WHERE n >= 5 AND r <= 8 ORDER BY r, o_custkey LIMIT 400")
def n15(spark, d):
    return select.cohort(read(spark, d, "orders"), "o_custkey", "o_orderkey", 5, 8, 400).select("o_orderkey")


@query("f1_chunks", "WITH l AS (SELECT doc_id, n_chars AS n, greatest(n_chars - 400, 0) AS last FROM documents), c AS (SELECT doc_id, n, unnest(list_sort(list_distinct(list_append(range(0, last + 1, 300), last)))) AS start FROM l) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk, start, least(start + 400, n) AS stop FROM c")
def f1(spark, d):
    return signal.chunks(read(spark, d, "documents"), "doc_id", "n_chars", 400, 300)


@query("p4_soft_labels", f"WITH {KNN(10)}, sc AS (SELECT src, label, sum(score) AS s FROM knn JOIN v ON id = dst GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, label) AS place FROM sc), e AS (SELECT *, exp((s - max(s) OVER (PARTITION BY src)) / 0.1) AS e FROM p WHERE place <= 3) SELECT src, label, round(e / sum(e) OVER (PARTITION BY src), 6) AS prob, place FROM e")
def p4(spark, d):
    return select.soft_labels(knn(spark, d, 10), nodes(spark, d), 3).withColumn("prob", F.round("prob", 6))


@query("p5_stable_groups", "WITH x AS (SELECT vec_id AS id, label AS a, vec_id % 7 AS b FROM embeddings), n AS (SELECT b, a, count(*) AS n FROM x GROUP BY 1, 2), w AS (SELECT b, a FROM n QUALIFY row_number() OVER (PARTITION BY b ORDER BY n DESC, a) = 1) SELECT id, b AS label FROM x JOIN w USING (b, a)")
def p5(spark, d):
    v = nodes(spark, d)
    return select.stable_groups(v, v.select("id", (F.col("id") % 7).alias("label")))


@query("st4_telemetry", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY 1, 2")
def st4(spark, d):
    return jobs.telemetry(read(spark, d, "events"))
