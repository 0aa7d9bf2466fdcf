"""Queries of reports over rankings, scores, conditions and trials, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, metrics, rerank, reports, sampling, select, vectors as x
from tessera.plans.base import FILES, KNN, QUERIES, SQL, VECTORS, files, knn, nodes, query, r6, read, vectors
from tessera.plans.evaluation import CURVE, HITS, PER, TRIALS, curve, per_query, trials
from tessera.plans.retrieval import ADJ, COMP, DEG, HALF, MUT5, POL, R14, ROUTE, W20, W60, Z, half, policies
from tessera.sources.lineage import cut
from tessera.sources import readers


def rounded(df, *exact):
    """Every column but the exact ones with six decimals."""
    return df.select([F.col(c) if c in exact else r6(c) for c in df.columns])


@query("p16_row_scores", f"WITH {KNN(10)} SELECT src, dst, round((score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-6), 6) AS minmax, round((count(*) OVER w - rank) / (count(*) OVER w - 1), 6) AS percentile FROM knn WINDOW w AS (PARTITION BY src)")
def p16(spark, d):
    return reports.row_scores(knn(spark, d, 10)).select("src", "dst", r6("minmax"), r6("percentile"))


@query("j7_suffix_merge", "WITH s AS (SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.n AS n_open, a.total AS total_open, b.n AS n_done, b.total AS total_done FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus = 'F'")
def j7(spark, d):
    s = read(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    side = lambda v: s.where(F.col("o_orderstatus") == v).drop("o_orderstatus")
    return reports.merged(side("O"), side("F"), ["o_custkey"], ("_open", "_done"))


@query("j10_unordered_pairs", "SELECT a.label, a.vec_id AS left, b.vec_id AS right FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def j10(spark, d):
    return reports.unordered_pairs(read(spark, d, "embeddings"), "label", "vec_id")


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@query("j15_enum_order", "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS severity FROM orders")
def j15(spark, d):
    return read(spark, d, "orders").select("o_orderkey", reports.enum_place(F.col("o_orderpriority"), PRIORITIES).alias("severity"))


@query("a19_enrolment_cache", f"WITH {VECTORS}, u AS (SELECT id, label * 100 + id % 4 AS owner, label, e[1] / sqrt(list_dot_product(e, e)) AS x FROM v) SELECT owner, count(*) AS n, count(DISTINCT label) AS speakers, string_agg(id::VARCHAR, ',' ORDER BY id) AS sources, round(avg(x), 6) AS first FROM u GROUP BY 1")
def a19(spark, d):
    v = vectors(spark, d).withColumn("owner", F.col("label").cast("long") * 100 + F.col("id") % 4)
    return reports.enrolment_cache(v, "owner", "id", "label", "v").select("owner", "n", "speakers", "sources", F.round(F.element_at("v", 1), 6).alias("first"))


@query("t3_worst_queries", f"WITH {PER} SELECT src, round(found / 10, 6) AS p_at_k, first_rank FROM q ORDER BY found, first_rank DESC, src LIMIT 100")
def t3(spark, d):
    return reports.worst_queries(per_query(spark, d), 100).select("src", r6("p_at_k"), F.col("first_rank").cast("long").alias("first_rank"))


@query("t4_top_hubs", f"WITH {KNN(10)}, {DEG} SELECT deg.id, in_degree, label FROM (SELECT * FROM deg ORDER BY in_degree DESC, id LIMIT 100) deg JOIN v ON v.id = deg.id")
def t4(spark, d):
    return reports.top_hubs(knn(spark, d, 10), nodes(spark, d), 10, 100)


@query("t6_best_row", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def t6(spark, d):
    return readers.best_row(read(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


def mutual_labels(spark, d):
    return graph.labelled_nodes(nodes(spark, d), graph.mutual(knn(spark, d, 20), 3, 3)).withColumnRenamed("component", "label")


G14 = f"""{W60}, {Z}, {ADJ}, {MUT5}, {COMP}, sz AS (SELECT *, count(*) OVER (PARTITION BY component) AS label_size FROM comp),
  mg AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10) AS margin FROM knn GROUP BY 1),
  sa AS (SELECT src, count(*) FILTER (a.component = b.component) AS same_label FROM adj JOIN sz a ON a.id = src JOIN sz b ON b.id = dst WHERE rank <= 60 GROUP BY 1),
  su AS (SELECT src, count(*) AS support FROM knn k WHERE rank <= 10 AND EXISTS (SELECT 1 FROM knn r WHERE r.rank <= 20 AND r.src = k.dst AND r.dst = k.src) GROUP BY 1),
  g14 AS (SELECT src, margin, coalesce(support, 0) AS support, label_size, same_label, label_size BETWEEN 2 AND 120 AND same_label >= 1 AS usable, same_label / greatest(least(label_size - 1, 60), 1) AS confidence FROM mg JOIN sz ON sz.id = src JOIN sa USING (src) LEFT JOIN su USING (src))"""


def diagnostics(spark, d):
    k = knn(spark, d, 60)
    return reports.tail_diagnostics(k, rerank.adjusted_ranking(k, 60), mutual_labels(spark, d), 10, 60, 20)


@query("g14_diagnostics", f"WITH {G14} SELECT src, round(margin, 6) AS margin, support, label_size, same_label, usable, round(confidence, 6) AS confidence FROM g14".replace("WITH WITH", "WITH"))
def g14(spark, d):
    return rounded(diagnostics(spark, d), "src", "support", "label_size", "same_label", "usable")


@query("r14_router_graph")
def r14_graph(spark, d):
    """The router over diagnostics of the real graph: entropy of class posteriors, overlap of the other rankings with the full one."""
    from tessera.functions.columns import normalised_entropy

    v = vectors(spark, d)
    p = x.class_posteriors(v, "label", 5).groupBy(F.col("id").alias("src")).agg(normalised_entropy(F.collect_list("prob")).alias("entropy"))
    pol = graph.cut(policies(spark, d))
    over = reports_overlap(pol)
    votes = rerank.consensus(pol, 10)
    agree = votes.where("policy = 'left'").select("src", F.col("consensus").alias("consensus_soup")).join(votes.where("policy = 'full_c4'").select("src", F.col("consensus").alias("consensus_full")), "src")
    rows = diagnostics(spark, d).join(p, "src").join(over, "src").join(agree, "src").withColumn("duration", F.lit(None).cast("double"))
    return rerank.route(rows, {"classaware", "soup", "exact", "weak", "reciprocal"}).select("src", "policy", "reason")


def reports_overlap(pol):
    o = rerank.overlaps(pol, "full_c4")
    return o.where("policy = 'exact'").select("src", F.col("overlap").alias("overlap_classaware")).join(o.where("policy = 'left'").select("src", F.col("overlap").alias("overlap_weak")), "src")


def teachers(spark, d):
    """The whole vectors and their halves: three neighbour tables."""
    return {"whole": knn(spark, d, 20), "left": half(spark, d, "left", 20), "right": half(spark, d, "right", 20)}


def packed_dropout(spark, d):
    """(main ranking, labels: its clusters and those without each teacher as one array for each id)."""
    t = list(teachers(spark, d).values())
    fused = cut(rerank.fuse_without([(k, 1.0) for k in t], 20, 20))
    return fused.where("variant = 0").drop("variant"), cut(graph.variant_components(nodes(spark, d), fused, len(t) + 1, 3))


def dropout(spark, d):
    """(main ranking, its clusters, the clusters without each teacher)."""
    main, packed = packed_dropout(spark, d)
    own = [packed.select("id", F.col("labels")[n].alias("label")) for n in range(4)]
    return main, own[0], own[1:]


@query("r15_teacher_dropout")
def r15(spark, d):
    main, labels = packed_dropout(spark, d)
    return rounded(reports.packed_stability(main, labels, 3, 10), "src")


@query("m2_hits", f"WITH {PER} SELECT src, (found > 0)::INT AS hit FROM q")
def m2_hits(spark, d):
    return per_query(spark, d).select("src", "hit")


def identified(spark, d):
    h = metrics.hits(knn(spark, d, 10).where("rank = 1"), nodes(spark, d))
    return metrics.identification_points(h.select((F.col("src") % 4 != 0).alias("mate"), (F.col("hit") == 1).alias("correct"), "score"), 0.0, 1.0, 11)


@query("m6_identification_rates", f"WITH {HITS}, t AS (SELECT src % 4 <> 0 AS mate, hit = 1 AS correct, score FROM h WHERE rank = 1), p AS (SELECT i, count(*) FILTER (mate AND correct AND score >= i / 10e0) AS tp, count(*) FILTER (NOT mate AND score >= i / 10e0) AS fp, count(*) FILTER (mate) AS m, count(*) FILTER (NOT mate) AS o FROM t, (SELECT unnest(range(0, 11)) AS i) GROUP BY 1) SELECT i AS at, o - fp AS tn, m - tp AS fn, round((m - tp) / m, 6) AS fnir, round(fp / o, 6) AS fpir FROM p")
def m6_rates(spark, d):
    return identified(spark, d).select("at", "tn", "fn", "fnir", "fpir")


@query("m7_fnir_at_fpir")
def m7(spark, d):
    """Miss rate at a false alarm rate of 0.01, 0.1 and 0.5, from the eleven points of the curve."""
    points = [(r.fpir, r.fnir) for r in identified(spark, d).orderBy("at").collect()]
    return spark.createDataFrame([(t, metrics.fnir_at_fpir(points, t)) for t in (0.01, 0.1, 0.5)], "fpir double, fnir double")


@query("m8_gallery_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('g|' || o_orderkey)) <= greatest(1, floor(count(*) OVER (PARTITION BY o_custkey) * 0.4)) THEN 'gallery' ELSE 'query' END AS side FROM orders")
def m8(spark, d):
    return reports.gallery_split(read(spark, d, "orders"), "o_custkey", "o_orderkey", "g", 0.4).select("o_orderkey", "side")


@query("m9_downsampled", f"WITH {CURVE}, o AS (SELECT threshold, far, frr, row_number() OVER (ORDER BY threshold DESC) - 1 AS place, count(*) OVER () AS n FROM curve) SELECT threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM o WHERE n <= 50 OR place IN (SELECT floor(i * (n - 1) / 49)::BIGINT FROM (SELECT unnest(range(0, 50)) AS i))")
def m9_downsampled(spark, d):
    return metrics.downsample(curve(spark, d), 50).select("threshold", r6("far"), r6("frr"))


@query("m10_eer_sql", f"WITH {CURVE}, c AS (SELECT *, far - frr AS d, lead(far - frr) OVER w AS d2, lead(far) OVER w AS far2, lead(threshold) OVER w AS t2 FROM curve WINDOW w AS (ORDER BY threshold DESC)), p AS (SELECT 0 AS kind, threshold AS place, far AS eer, threshold AS t, 0 AS far_off FROM c WHERE abs(d) <= 1e-12 UNION ALL SELECT 1, threshold, far + d / (d - d2) * (far2 - far), threshold + d / (d - d2) * (t2 - threshold), 0 FROM c WHERE d * d2 < 0 UNION ALL SELECT 2, threshold, (far + frr) / 2, threshold, abs(d) FROM c) SELECT round(eer, 6) AS eer, round(t, 6) AS threshold FROM p ORDER BY kind, far_off, place DESC LIMIT 1")
def m10_sql(spark, d):
    return metrics.eer(curve(spark, d))


@query("m15_losses", f"WITH {TRIALS}, p AS (SELECT label, greatest(1e-12, least(1 - 1e-12, (score + 1) / 2)) AS p FROM t) SELECT round(avg((p - label) * (p - label)), 6) AS brier, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM p")
def m15_losses(spark, d):
    return rounded(reports.probability_losses(trials(spark, d), (F.col("score") + 1) / 2))


def HUB(k: int) -> str:
    return f"(WITH g AS (SELECT v.id, count(kn.src) AS x FROM v LEFT JOIN (SELECT * FROM knn WHERE rank <= {k}) kn ON kn.dst = v.id GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x, id) AS i, count(*) OVER () AS n FROM g) SELECT {k}::BIGINT AS k, quantile_cont(x, 0.5) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, max(x) AS most, round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 8) AS gini FROM r)"


@query("m18_hubness", f"{W60} SELECT * FROM {HUB(10)} UNION ALL SELECT * FROM {HUB(50)}")
def m18(spark, d):
    h = reports.hubness(knn(spark, d, 60), nodes(spark, d), (10, 50))
    return h.select("k", "p50", r6("p95"), r6("p99"), "most", "gini")


@query("m20_agreement", f"{W60}, {Z}, {ADJ}, j AS (SELECT coalesce(a.src, b.src) AS src, a.rank AS ra, b.rank AS rb FROM (SELECT * FROM knn WHERE rank <= 10) a FULL JOIN (SELECT * FROM adj WHERE rank <= 10) b ON a.src = b.src AND a.dst = b.dst), su AS (SELECT src, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS o, count(*) FILTER (ra = rb) AS c, count(*) FILTER (ra = 1 AND rb = 1) AS t FROM j GROUP BY 1) SELECT round(avg(o), 6) AS mean_overlap, median(o)::DOUBLE AS median_overlap, round(sum(c) / (count(*) * 10), 6) AS same_cells, round(avg((c = 10)::INT), 6) AS same_order, round(avg((o = 10)::INT), 6) AS same_set, round(avg((t = 1)::INT), 6) AS same_top1 FROM su")
def m20(spark, d):
    k = knn(spark, d, 60)
    return rounded(reports.agreement_summary(k, rerank.adjusted_ranking(k, 60), 10))


def distorted(spark, d):
    """Vectors whose every eighth component is halved."""
    return vectors(spark, d).select("id", F.transform("v", lambda e, i: F.when(i % 8 == 0, e * 0.5).otherwise(e)).alias("v"), "label")


@query("m21_drift", f"WITH {VECTORS}, b AS (SELECT id, e, [CASE WHEN i % 8 = 1 THEN e[i] * 0.5 ELSE e[i] END FOR i IN range(1, 65)] AS f FROM v), s AS (SELECT list_cosine_similarity(e, f) AS cos FROM b), t AS (SELECT cos, sqrt(greatest(2 - 2 * cos, 0)) AS l2 FROM s) SELECT round(avg(cos), 6) AS cosine_mean, round(quantile_cont(cos, 0.95), 6) AS cosine_p95, round(avg(l2), 6) AS l2_mean, round(quantile_cont(l2, 0.95), 6) AS l2_p95 FROM t")
def m21(spark, d):
    return rounded(reports.drift(vectors(spark, d), distorted(spark, d)))


@query("m21_gaps", f"WITH {TRIALS}, b AS (SELECT label, score, score * 0.9 + (id % 7) / 100e0 AS now FROM t) SELECT round(avg(now) FILTER (label = 1), 6) AS positive_mean_score, round(avg(now) FILTER (label = 0), 6) AS negative_mean_score, round(avg(now) FILTER (label = 1) - avg(now) FILTER (label = 0), 6) AS separation_gap, round(avg(now) FILTER (label = 1) - avg(now) FILTER (label = 0) - avg(score) FILTER (label = 1) + avg(score) FILTER (label = 0), 6) AS separation_gap_delta FROM b")
def m21_gaps(spark, d):
    t = trials(spark, d).withColumnRenamed("id", "trial")
    return rounded(reports.score_gaps(t, t.withColumn("score", F.col("score") * 0.9 + (F.col("trial") % 7) / 100)))


@query("m21_self_retrieval", f"WITH {VECTORS}, b AS (SELECT id, [CASE WHEN i % 8 = 1 THEN e[i] * 0.5 ELSE e[i] END FOR i IN range(1, 65)] AS f FROM v), n AS (SELECT b.id, v.id AS other, row_number() OVER (PARTITION BY b.id ORDER BY list_cosine_similarity(b.f, v.e) DESC, v.id) AS r FROM b, v) SELECT count(*) AS rows, round(avg((id = other)::INT), 6) AS self_retrieval_at1 FROM n WHERE r = 1")
def m21_self(spark, d):
    return rounded(reports.self_retrieval(vectors(spark, d), distorted(spark, d)), "rows")


COND = "c AS (SELECT l_returnflag AS model, l_linestatus || l_linenumber AS condition, l_linestatus AS family, CASE l_linenumber WHEN 2 THEN 'light' WHEN 3 THEN 'medium' WHEN 4 THEN 'heavy' ELSE 'clean' END AS severity, avg(l_discount) AS eer, avg(l_tax) AS min_dcf FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_returnflag, l_linestatus, l_linenumber), b AS (SELECT model, avg(eer) AS be, avg(min_dcf) AS bd FROM c WHERE severity = 'clean' GROUP BY 1), g AS (SELECT c.*, 0.5 * greatest((eer - be) / greatest(be, 1e-6), 0) + 0.5 * greatest((min_dcf - bd) / greatest(bd, 1e-6), 0) AS degradation FROM c JOIN b USING (model))"


def degraded(spark, d):
    c = read(spark, d, "lineitem").where("l_linenumber <= 4").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_discount").alias("eer"), F.avg("l_tax").alias("min_dcf"))
    names = F.when(F.col("l_linenumber") == 2, "light").when(F.col("l_linenumber") == 3, "medium").when(F.col("l_linenumber") == 4, "heavy").otherwise("clean")
    c = c.select(F.col("l_returnflag").alias("model"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("condition"), F.col("l_linestatus").alias("family"), names.alias("severity"), "eer", "min_dcf")
    return reports.degradation(c, c.where("severity = 'clean'").groupBy("model").agg(F.avg("eer").alias("eer"), F.avg("min_dcf").alias("min_dcf")))


@query("m22_degradation", f"WITH {COND} SELECT model, condition, round(degradation, 6) AS degradation FROM g")
def m22(spark, d):
    return degraded(spark, d).select("model", "condition", r6("degradation"))


@query("m23_monotonicity", f"WITH {COND} SELECT model, family, round(max(degradation) FILTER (severity = 'light'), 6) AS light, round(max(degradation) FILTER (severity = 'medium'), 6) AS medium, round(max(degradation) FILTER (severity = 'heavy'), 6) AS heavy, coalesce(max(degradation) FILTER (severity = 'light') <= max(degradation) FILTER (severity = 'medium') AND max(degradation) FILTER (severity = 'medium') <= max(degradation) FILTER (severity = 'heavy'), false) AS is_monotonic FROM g GROUP BY 1, 2")
def m23(spark, d):
    return rounded(reports.monotonicity(degraded(spark, d), ["light", "medium", "heavy"]), "model", "family", "is_monotonic")


@query("m23_pairing", f"WITH {COND} SELECT a.condition, b.eer < a.eer AS second_better_eer, b.min_dcf < a.min_dcf AS second_better_min_dcf, b.degradation < a.degradation AS second_more_robust FROM g a JOIN g b ON a.condition = b.condition AND a.model = 'A' AND b.model = 'R'")
def m23_pairing(spark, d):
    return reports.paired(degraded(spark, d), "A", "R")


GRID = "r AS (SELECT CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS bucket, coalesce(lang, 'none') AS profile, source, doc_id % 3 AS truth, n_chars FROM documents)"


@query("m25_regime_grid", f"WITH {GRID}, k AS (SELECT b AS bucket, p AS profile FROM (SELECT unnest(['short', 'middle', 'long']) AS b), (SELECT unnest(['en', 'de', 'fr', 'it']) AS p)), n AS (SELECT bucket, profile, count(*) AS rows, median(n_chars) AS m FROM r GROUP BY 1, 2), q AS (SELECT bucket, profile, sum(good) / nullif(sum(every), 0) AS purity FROM (SELECT bucket, profile, source, sum(n * (n - 1) / 2) AS good, sum(n) * (sum(n) - 1) / 2 AS every FROM (SELECT bucket, profile, source, truth, count(*) AS n FROM r GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT bucket, profile, coalesce(rows, 0) AS rows, round(coalesce(purity, 0), 6) AS purity, m::DOUBLE AS median_margin FROM k LEFT JOIN n USING (bucket, profile) LEFT JOIN q USING (bucket, profile)")
def m25(spark, d):
    n = F.col("n_chars")
    rows = read(spark, d, "documents").select(F.when(n < 300, "short").when(n < 2000, "middle").otherwise("long").alias("bucket"), F.coalesce("lang", F.lit("none")).alias("profile"), "source", (F.col("doc_id") % 3).alias("truth"), "n_chars")
    g = reports.regime_grid(rows, ("bucket", ["short", "middle", "long"]), ("profile", ["en", "de", "fr", "it"]), "source", "truth", "n_chars")
    return g.withColumn("purity", F.round("purity", 6))


@query("m26_bootstrap", "WITH v AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_acctbal AS x, count(*) OVER () AS n FROM supplier), d AS (SELECT s AS sample, (((s * 7919 + place * 104729 + s * place * 31 + 12345) % 2147483647) * 48271) % 2147483647 % n AS place FROM v, (SELECT unnest(range(0, 200)) AS s)), m AS (SELECT sample, avg(x) AS m FROM d JOIN v USING (place) GROUP BY 1) SELECT (SELECT round(avg(x), 6) FROM v) AS mean, (SELECT round(stddev_pop(x), 6) FROM v) AS deviation, round(quantile_cont(m, 0.025), 6) AS ci95_low, round(quantile_cont(m, 0.975), 6) AS ci95_high FROM m")
def m26(spark, d):
    return rounded(reports.bootstrap(read(spark, d, "supplier"), "s_acctbal", [F.asc("s_suppkey")], 200))


@query("m27_signed_ranks", "WITH d AS (SELECT round(avg(o_totalprice) FILTER (o_orderkey % 2 = 0) - avg(o_totalprice) FILTER (o_orderkey % 2 = 1), -3) AS d FROM orders GROUP BY o_custkey), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d WHERE d <> 0 AND d IS NOT NULL), s AS (SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, sum(t * t - 1) AS ties FROM r) SELECT n, (SELECT round(avg(d), 6) FROM d WHERE d IS NOT NULL) AS mean_delta, w_plus, w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 6) AS z, 'ok' AS note FROM s")
def m27(spark, d):
    even = lambda v: F.avg(F.when(F.col("o_orderkey") % 2 == v, F.col("o_totalprice")))
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.round(even(0) - even(1), -3).alias("a")).where("a is not null").withColumn("b", F.lit(0.0))
    return rounded(reports.signed_ranks(o, "a", "b"), "n", "note")


@query("m28_round_gate", f"WITH {VECTORS}, {HALF('knn', '')}, {HALF('l', '[1:32]')}, o AS (SELECT src, count(*) FILTER (b.dst IS NOT NULL) / 10e0 AS o FROM (SELECT * FROM knn WHERE rank <= 10) a LEFT JOIN (SELECT src, dst FROM l WHERE rank <= 10) b USING (src, dst) GROUP BY 1), m AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS m FROM knn GROUP BY 1), n AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS m FROM l GROUP BY 1), g AS (SELECT (SELECT avg(o) FROM o) AS overlap, median(n.m - m.m) AS margin_gain FROM m JOIN n USING (src)) SELECT round(overlap, 6) AS overlap, round(margin_gain, 6) AS margin_gain, overlap < 0.3 OR margin_gain >= 0.01 AS passes FROM g".replace("b.dst IS NOT NULL", "b.hit IS NOT NULL").replace("SELECT src, dst FROM l WHERE rank <= 10", "SELECT src, dst, 1 AS hit FROM l WHERE rank <= 10"))
def m28(spark, d):
    return rounded(reports.round_gate(knn(spark, d, 20), half(spark, d, "left", 20), 10, 0.3, 0.01), "passes")


def far_trials(spark, d):
    """Each vector against the five ids after it and one id that no table knows."""
    v = vectors(spark, d).where("id % 7 <> 3")
    pairs = vectors(spark, d).select(F.col("id").alias("left_id"), "label", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("o")).withColumn("right_id", F.col("left_id") + F.col("o"))
    b = vectors(spark, d).select(F.col("id").alias("right_id"), F.col("label").alias("lb"))
    return x.pair_scores(pairs.join(b, "right_id"), v).select((F.col("label") == F.col("lb")).cast("int").alias("label"), "score")


@query("m29_trial_summary", f"WITH {VECTORS}, t AS (SELECT (a.label = b.label)::INT AS label, CASE WHEN a.id % 7 <> 3 AND b.id % 7 <> 3 THEN list_cosine_similarity(a.e, b.e) END AS score FROM v a JOIN v b ON b.id BETWEEN a.id + 1 AND a.id + 5) SELECT count(*) AS trials, count(*) FILTER (score IS NULL) AS missing, round(avg(score) FILTER (label = 1), 6) AS positive_mean, round(avg(score) FILTER (label = 0), 6) AS negative_mean, round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) AS gap FROM t")
def m29(spark, d):
    return rounded(reports.trial_summary(far_trials(spark, d)), "trials", "missing")


POOL = ["duration_s", "rms_dbfs", "silence_ratio_40db"]
M30 = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}) FILTER (split = 'train'), 6) AS local_mean, round(avg({m}) FILTER (split = 'test'), 6) AS public_mean, round(avg({m}) FILTER (split = 'train') - avg({m}) FILTER (split = 'test'), 6) AS mean_gap, round(stddev_pop({m}) FILTER (split = 'train'), 6) AS local_deviation, round(stddev_pop({m}) FILTER (split = 'test'), 6) AS public_deviation FROM files" for m in POOL)


@query("m30_pool_alignment", f"WITH {FILES} {M30}")
def m30(spark, d):
    return rounded(reports.pool_alignment(files(spark, d), F.col("split") == "train", POOL), "metric")


@query("m31_cohesion", f"WITH {VECTORS}, p AS (SELECT a.label, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.id < b.id) SELECT label, count(*) AS pairs, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS deviation, round(min(s), 6) AS least, round(quantile_cont(s, 0.1), 6) AS p10 FROM p GROUP BY 1")
def m31(spark, d):
    return rounded(reports.cohesion(vectors(spark, d)), "label", "pairs")


@query("m32_speaker_quality", f"WITH {PER}, t AS (SELECT src, own, max(score) FILTER (rank = 1) AS top1 FROM h GROUP BY 1, 2) SELECT own AS label, count(*) AS queries, round(avg(found / 10), 6) AS mean_p, round(avg(top1), 6) AS mean_top1, round(avg(first_rank), 6) AS mean_first_rank FROM q JOIN t USING (src) GROUP BY 1")
def m32(spark, d):
    return rounded(reports.speaker_quality(per_query(spark, d)), "label", "queries")


@query("m33_norms", f"WITH {VECTORS}, n AS (SELECT label, sqrt(list_dot_product(e, e)) AS n FROM v) SELECT label, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM n GROUP BY 1")
def m33(spark, d):
    from tessera.functions.columns import norm

    n = vectors(spark, d).select("label", norm(F.col("v")).alias("n"))
    return rounded(n.groupBy("label").agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.9)).alias("p90")), "label")


@query("m34_router_usage", f"SELECT reason AS policy, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({ROUTE.format(f=R14)}) GROUP BY 1")
def m34(spark, d):
    from tessera.plans.base import QUERIES

    return rounded(reports.usage(QUERIES["r14_router"](spark, d).select(F.col("reason").alias("policy"))), "policy", "rows")


@query("m34_policy_overlap", f"{POL}, o AS (SELECT p.policy, p.src, count(f.dst) AS o FROM pol p LEFT JOIN (SELECT * FROM pol WHERE policy = 'full_c4') f ON f.src = p.src AND f.dst = p.dst GROUP BY 1, 2) SELECT policy, round(avg(o), 6) AS mean, quantile_cont(o, 0.5) AS p50, round(quantile_cont(o, 0.1), 6) AS p10 FROM o GROUP BY 1")
def m34_overlap(spark, d):
    return rounded(reports.policy_overlap(rerank.overlaps(policies(spark, d), "full_c4")), "policy", "p50")


@query("m35_runtime", "SELECT event_type, count(*) AS items, round(sum(value), 6) AS seconds, round(count(*) / sum(value), 6) AS items_per_second, round(sum(value) / sum(user_id + 1), 6) AS real_time_factor FROM events GROUP BY ROLLUP (event_type)")
def m35(spark, d):
    return rounded(reports.runtime(read(spark, d, "events").withColumn("audio", (F.col("user_id") + 1).cast("double")), "event_type", "value", "audio"), "event_type", "items")


@query("m36_parity", f"WITH {VECTORS}, c AS (SELECT id, e, i, round(e[i], 4) AS on_, e[i] AS off FROM v, (SELECT unnest(range(1, 65)) AS i)) SELECT id, count(*) AS cells, round(max(abs(on_ - off)), 9) AS most, max(abs(on_ - off)) <= 4.9e-5 AS same FROM c GROUP BY 1")
def m36(spark, d):
    cells = vectors(spark, d).select("id", F.posexplode("v").alias("i", "x"))
    p = reports.parity(cells.withColumn("x", F.round("x", 4)), cells, ["id", "i"], "id", "x", 4.9e-5)
    return p.withColumn("most", F.round("most", 9))


@query("n2_stratified_split", "WITH o AS (SELECT o_custkey AS owner, count(*) AS c FROM orders GROUP BY 1), b AS (SELECT owner, CASE WHEN c < 5 THEN 'few' WHEN c < 15 THEN 'some' ELSE 'many' END AS bin FROM o), r AS (SELECT *, count(*) OVER (PARTITION BY bin) AS n, row_number() OVER (PARTITION BY bin ORDER BY sha256('s|' || owner)) AS r FROM b), t AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE greatest(1, round(n * 0.2)) END AS nt FROM r), v AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE least(greatest(1, round(n * 0.1)), n - nt - 1) END AS nv FROM t) SELECT owner, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END AS split FROM v")
def n2(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.count("*").alias("c"))
    o = o.select("owner", F.when(F.col("c") < 5, "few").when(F.col("c") < 15, "some").otherwise("many").alias("bin"))
    return sampling.stratified_split(o, "owner", "bin", "s", 0.1, 0.2).select("owner", "split")


def roled(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 25 == 0, "enrollment").when(F.col("vec_id") % 5 == 1, "test").alias("role"))


@query("n11_role_trials", 'SELECT a.vec_id AS "left", b.vec_id AS "right", (a.label = b.label)::INT AS label FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0 AND b.vec_id % 5 = 1')
def n11_trials(spark, d):
    return reports.role_trials(roled(spark, d), "vec_id", "label", "role", 64)


@query("n11_pair_trials", 'SELECT a.vec_id AS "left", b.vec_id AS "right", (a.label = b.label)::INT AS label FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id')
def n11_pairs(spark, d):
    return reports.role_trials(roled(spark, d).withColumn("role", F.lit("none")), "vec_id", "label", "role", 256)


CONDITIONS = [("noise_light", "noise", "light"), ("noise_heavy", "noise", "heavy"), ("reverb_light", "reverb", "light"), ("codec_medium", "codec", "medium"), ("clip_heavy", "clipping", "heavy")]


@query("n13_distortion_plan", "SELECT doc_id, c.condition, c.family, c.severity, substr(sha256(c.condition || '|' || doc_id), 1, 8) AS seed FROM documents, (VALUES " + ", ".join(map(str, CONDITIONS)) + ") c(condition, family, severity)")
def n13_plan(spark, d):
    return reports.distortion_plan(read(spark, d, "documents"), "doc_id", CONDITIONS)


FAMILIES = [("noise", 3.0), ("reverb", 2.0), ("codec", 1.0)]
UNIT = "('0x' || substr(sha256('{a}|{b}|3|' || doc_id), 1, 12))::BIGINT / 281474976710656e0"


@query("n15_augmentation", f"WITH u AS (SELECT doc_id, {UNIT.format(a='s', b='any')} AS a, {UNIT.format(a='s', b='family')} AS f FROM documents) SELECT doc_id, CASE WHEN a < 0.38 THEN CASE WHEN f < 3 / 6e0 THEN 'noise' WHEN f < 3 / 6e0 + 2 / 6e0 THEN 'reverb' ELSE 'codec' END END AS family FROM u")
def n15_schedule(spark, d):
    return reports.augmentation_schedule(read(spark, d, "documents"), "doc_id", 3, (5, 0.2, 0.5), FAMILIES, "s")


@query("n15_coverage", f"WITH u AS (SELECT doc_id, {UNIT.format(a='s', b='any')} AS a, {UNIT.format(a='s', b='family')} AS f FROM documents), r AS (SELECT CASE WHEN a < 0.38 THEN CASE WHEN f < 3 / 6e0 THEN 'noise' WHEN f < 3 / 6e0 + 2 / 6e0 THEN 'reverb' ELSE 'codec' END END AS policy FROM u) SELECT policy, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY 1")
def n15_coverage(spark, d):
    plan = reports.augmentation_schedule(read(spark, d, "documents"), "doc_id", 3, (5, 0.2, 0.5), FAMILIES, "s")
    return rounded(reports.usage(plan.withColumnRenamed("family", "policy")), "policy", "rows")


@query("n16_validation_pool", f"WITH {FILES} SELECT row_index, split FROM files WHERE speaker_id IS NOT NULL AND error IS NULL QUALIFY row_number() OVER (PARTITION BY split ORDER BY row_index) <= 40")
def n16(spark, d):
    f = files(spark, d).where("speaker_id is not null and error is null")
    return sampling.capped(f, "split", [F.asc("row_index")], 1, 40).select("row_index", "split")


SIZED = f"{W20}, {MUT5}, {COMP}, sl AS (SELECT id, component AS label, count(*) OVER (PARTITION BY component) AS size FROM comp)"


@query("l1_by_size", f"{SIZED} SELECT id, label, size, dense_rank() OVER (ORDER BY label) - 1 AS pseudo FROM sl WHERE size BETWEEN 2 AND 60")
def l1(spark, d):
    return select.by_size(mutual_labels(spark, d), 2, 60)


VOTE = "SELECT src, (count(*) FILTER (a.label = b.label) >= 1)::INT AS yes FROM {n} JOIN sl a ON a.id = src JOIN sl b ON b.id = dst WHERE rank <= 10 GROUP BY src"


@query("l2_strict_consensus", f"{SIZED}, {HALF('l', '[1:32]')}, {HALF('r', '[33:64]')}, m AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10) AS margin FROM knn GROUP BY 1), b AS (SELECT greatest(quantile_cont(margin, 0.2), 0.01) AS bound FROM m), c AS (SELECT src, sum(yes) AS confirmed FROM ({VOTE.format(n='l')} UNION ALL {VOTE.format(n='r')}) GROUP BY 1), x AS (SELECT id, label, size, margin, confirmed, size BETWEEN 2 AND 60 AND margin >= bound AND confirmed >= 1 AS ok FROM sl JOIN m ON m.src = id JOIN c ON c.src = id, b) SELECT id, label, round(margin, 6) AS margin, confirmed::BIGINT AS confirmed, ok AND count(*) FILTER (ok) OVER (PARTITION BY label) >= 2 AND count(*) FILTER (ok) OVER (PARTITION BY label) / size >= 0.5 AS kept FROM x")
def l2(spark, d):
    out = select.strict_consensus(mutual_labels(spark, d), knn(spark, d, 20), [half(spark, d, "left", 20), half(spark, d, "right", 20)], (2, 60), 0.01, 0.2, 10, 1, 1, 2, 0.5)
    return out.withColumn("margin", F.round("margin", 6))


@query("l3_weighted", f"{SIZED}, m0 AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10) AS margin FROM knn GROUP BY 1), m AS (SELECT src, greatest(0, least(1, (margin - lo) / greatest(hi - lo, 1e-6))) AS m FROM m0, (SELECT quantile_cont(margin, 0.05) AS lo, quantile_cont(margin, 0.95) AS hi FROM m0)), g AS (SELECT src, count(*) FILTER (a.label = b.label) / 10e0 AS g FROM knn JOIN sl a ON a.id = src JOIN sl b ON b.id = dst WHERE rank <= 10 GROUP BY 1), r AS (SELECT src, count(*) / 10e0 AS r FROM knn k WHERE rank <= 10 AND EXISTS (SELECT 1 FROM knn q WHERE q.rank <= 10 AND q.src = k.dst AND q.dst = k.src) GROUP BY 1), x AS (SELECT id, (0.4 * m + 0.3 * g + 0.2 * coalesce(r, 0)) / 0.9 AS confidence FROM sl JOIN m ON m.src = id JOIN g ON g.src = id LEFT JOIN r ON r.src = id WHERE size BETWEEN 2 AND 60) SELECT id, round(confidence, 6) AS confidence, round(0.5 + 0.5 * (confidence - 0.1) / 0.9, 6) AS weight FROM x WHERE confidence >= 0.1")
def l3(spark, d):
    return rounded(select.weighted(mutual_labels(spark, d), knn(spark, d, 20), (2, 60), 10, 0.1), "id")


@query("l4_soft_labels")
def l4_soft(spark, d):
    """Multi-teacher soft labels from end to end: fusion, cluster-first clusters, confidence, softmax over clusters, renormalised over kept ones."""
    main, groups = packed_dropout(spark, d)
    labels = rerank.cluster_first(main.select("src", "dst", "rank", "score"), nodes(spark, d), edge_top=10, reciprocal_top=20, rank_top=20, sizes=(3, 60), least_candidates=2, shared_top=10, shared_min=1)[1]
    sure = rounded(teacher_confidence(main, groups), "src")
    return rounded(select.kept_soft_labels(select.soft_labels(main, labels, 5), labels, sure, (3, 60), 0.3), "src", "label", "place")


def teacher_confidence(main, labels):
    from tessera.operators import profile

    agree = main.where("rank <= 10").groupBy("src").agg((F.avg("seen") / 3).alias("value"))
    place = lambda df: profile.numbered(df, [F.asc("y"), F.asc("src")], "at")
    n = F.broadcast(main.select("src").distinct().agg(F.count("*").alias("n")))
    share = lambda df: place(df).join(n).select("src", ((F.col("at") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("value"))
    margin = share(graph.margins(main, 1, 10).select("src", F.round("margin", 9).alias("y")))
    density = share(graph.density_z(main).select(F.col("id").alias("src"), F.round("z", 9).alias("y")))
    stable = reports.packed_stability(main, labels, 3, 10).select("src", F.col("stability").alias("value"))
    return reports.teacher_confidence(agree, margin, density, stable)


@query("l4_teacher_confidence")
def l4(spark, d):
    """Confidence of multi-teacher soft labels: share of teachers that agree, margin and density percentiles, stability under dropout."""
    return rounded(teacher_confidence(*packed_dropout(spark, d)), "src")


FEATURES = "x AS (SELECT doc_id AS id, source, lang, n_chars / 1e2 AS a, (doc_id * 13) % 100 / 1e2 AS b, (doc_id * 29) % 100 / 1e2 AS c FROM documents)"
DISTANCE = "1.0 * power((a - ma) / sa, 2) + 0.5 * power((b - mb) / sb, 2) + 2.0 * power((c - mc) / sc, 2)"
L6 = f"{FEATURES}, mu AS (SELECT median(a) AS ma, median(b) AS mb, median(c) AS mc FROM x WHERE lang = 'en'), sg AS (SELECT greatest(stddev_pop(a), 1e-6) AS sa, greatest(stddev_pop(b), 1e-6) AS sb, greatest(stddev_pop(c), 1e-6) AS sc FROM x), tau AS (SELECT quantile_cont({DISTANCE}, 0.9) AS distance FROM x, mu, sg WHERE lang = 'en'), dv AS (SELECT source, 1.0 * stddev_pop(a) / any_value(sa) + 0.5 * stddev_pop(b) / any_value(sb) + 2.0 * stddev_pop(c) / any_value(sc) AS dd FROM x, sg WHERE lang = 'en' GROUP BY 1 HAVING count(*) >= 3), fl AS (SELECT quantile_cont(dd, 0.1) AS diversity FROM dv)"


def featured(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id as id", "source", "lang", "n_chars / 1e2 as a", "(doc_id * 13) % 100 / 1e2 as b", "(doc_id * 29) % 100 / 1e2 as c")


def prior(spark, d):
    f = featured(spark, d)
    return reports.acoustic_prior(f.where("lang = 'en'"), f, "source", ["a", "b", "c"], {"a": 1.0, "b": 0.5, "c": 2.0}, 0.9, 0.1, 3)


@query("l6_acoustic_prior", f"WITH {L6} SELECT round(ma, 6) AS ma, round(mb, 6) AS mb, round(mc, 6) AS mc, round(sa, 6) AS sa, round(sb, 6) AS sb, round(sc, 6) AS sc, round(distance, 6) AS distance, round(diversity, 6) AS diversity FROM mu, sg, tau, fl")
def l6(spark, d):
    p = prior(spark, d)
    row = [round(p["centre"][n], 6) for n in "abc"] + [round(p["scale"][n], 6) for n in "abc"] + [round(p["distance"], 6), round(p["diversity"], 6)]
    return spark.createDataFrame([tuple(row)], "ma double, mb double, mc double, sa double, sb double, sc double, distance double, diversity double")


@query("l5_prior_selected", f"WITH {L6}, k AS (SELECT *, (id * 7919) % 41 AS component, {DISTANCE} AS far FROM x, mu, sg), g AS (SELECT component, median(far) AS dist, 1.0 * stddev_pop(a) / any_value(sa) + 0.5 * stddev_pop(b) / any_value(sb) + 2.0 * stddev_pop(c) / any_value(sc) AS dv FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 1000), s AS (SELECT g.* FROM g, tau, fl WHERE dist <= distance AND dv >= diversity) SELECT id, component, round(dist, 6) AS distance, round(dv, 6) AS diversity FROM k JOIN s USING (component) QUALIFY row_number() OVER (PARTITION BY component ORDER BY a DESC, id) <= 5")
def l5(spark, d):
    f = featured(spark, d)
    parts = f.select("id", ((F.col("id") * 7919) % 41).alias("component"))
    return rounded(reports.prior_selected(parts, f, prior(spark, d), F.desc("a"), (2, 1000), 5), "id", "component")


@query("l5_margin_components", f"{W20}, m AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM knn GROUP BY 1), mut5 AS (SELECT k.src, k.dst FROM knn k JOIN m a ON a.src = k.src AND a.margin >= 0.005 JOIN m b ON b.src = k.dst AND b.margin >= 0.005 WHERE k.rank <= 5 AND EXISTS (SELECT 1 FROM knn r WHERE r.rank <= 5 AND r.src = k.dst AND r.dst = k.src)), {COMP} SELECT id, component FROM comp")
def l5_components(spark, d):
    e = graph.mutual_margin_edges(knn(spark, d, 20), 5, 0.005)
    return graph.labelled_nodes(nodes(spark, d), e.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("l7_contraction", f"WITH {VECTORS}, {HALF('knn', '')}, {HALF('l', '[1:32]')}, c AS (SELECT id, label AS a, id % 7 AS b FROM v), n AS (SELECT b, a, count(*) AS n FROM c GROUP BY 1, 2), w AS (SELECT b, a FROM n QUALIFY row_number() OVER (PARTITION BY b ORDER BY n DESC, a) = 1), m AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS m FROM knn GROUP BY 1), k AS (SELECT src, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS m FROM l GROUP BY 1) SELECT id, b AS label, round(k.m - m.m, 6) AS gain FROM c JOIN w USING (b, a) JOIN m ON m.src = id JOIN k ON k.src = id WHERE k.m - m.m >= 0.0")
def l7(spark, d):
    v = nodes(spark, d)
    kept = select.stable_groups(v, v.select("id", (F.col("id") % 7).alias("label")))
    gain = graph.margins(knn(spark, d, 20), 1, 2).join(graph.margins(half(spark, d, "left", 20), 1, 2).withColumnRenamed("margin", "after"), "src").select(F.col("src").alias("id"), (F.col("after") - F.col("margin")).alias("gain"))
    return kept.join(gain, "id").where("gain >= 0.0").select("id", "label", r6("gain"))


@query("l8_cohort_bank", "WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high', '3-medium') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)), c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM f) SELECT o_orderkey FROM c WHERE n >= 3 AND r <= 6 ORDER BY r, o_custkey LIMIT 400")
def l8(spark, d):
    from tessera.sources import schema

    o = schema.metadata_filter(read(spark, d, "orders"), {"o_orderpriority": ["1-Urgent", "2-High", "3-Medium"]})
    taken = read(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("key"))
    o = schema.without_overlap(o, "o_orderkey", F.array(F.col("o_custkey").cast("string")), taken, fallback=True)
    return select.cohort(o, "o_custkey", "o_orderkey", 3, 6, 400).select("o_orderkey")


@query("l9_soft_metadata", f"WITH {KNN(10)}, sc AS (SELECT src, label, sum(score) AS s FROM knn JOIN v ON id = dst GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 12) DESC, label) AS place FROM sc), e AS (SELECT *, exp((s - max(s) OVER (PARTITION BY src)) / 0.1) AS e FROM p WHERE place <= 3), q AS (SELECT src, place, label, e / sum(e) OVER (PARTITION BY src) AS prob FROM e), n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS no FROM (SELECT DISTINCT label FROM v)) SELECT src, string_agg(no::VARCHAR, ',' ORDER BY place) AS class_index, round(list(prob ORDER BY place)[1], 5) AS first_prob, count(*) AS n FROM q JOIN n USING (label) GROUP BY 1")
def l9(spark, d):
    v = nodes(spark, d)
    classes = graph.dense(v.select("id", "label")).join(v.withColumnRenamed("label", "name"), "id").select(F.col("name").alias("label"), F.col("label").alias("at")).distinct()
    s = reports.soft_metadata(select.soft_labels(knn(spark, d, 10), v, 3), classes)
    return s.select("src", F.concat_ws(",", F.transform("class_index", lambda c: c.cast("string"))).alias("class_index"), F.round(F.element_at("probs", 1), 5).alias("first_prob"), F.size("probs").cast("long").alias("n"))


@query("c_date_functions", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, year(o_orderdate) AS y, quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def c_dates(spark, d):
    t = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.date_trunc("month", t).cast("timestamp").alias("month"), F.datediff(t, F.lit("1992-01-01")).cast("long").alias("days"), F.year(t).cast("long").alias("y"), F.quarter(t).cast("long").alias("q"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp(t.cast("timestamp")).alias("seconds"))


@query("c_casts", "SELECT event_id, try_cast(event_type AS BIGINT) AS bad_number, value::BIGINT - (value::BIGINT > value)::BIGINT AS whole, event_id::VARCHAR AS text, (event_id % 2)::BOOLEAN AS flag, try_cast(event_id::VARCHAR AS DOUBLE) AS back FROM events".replace("value::BIGINT - (value::BIGINT > value)::BIGINT", "trunc(value)::BIGINT"))
def c_casts(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.col("event_type").try_cast("bigint").alias("bad_number"), F.col("value").cast("bigint").alias("whole"), F.col("event_id").cast("string").alias("text"), (F.col("event_id") % 2).cast("boolean").alias("flag"), F.col("event_id").cast("string").try_cast("double").alias("back"))


SQL["m10_eer"] = SQL["m10_eer_sql"]
