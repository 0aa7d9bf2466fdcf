"""Queries over embeddings: search, graph steps, re-ranking, fusion, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import graph, rerank, vectors as x
from tessera.operators.quantiles import quantiles
from tessera.plans.base import KNN, PAIRS, VECTORS, knn, nodes, query, r6, read, vectors
from tessera.sources import sinks
from tessera.operators.skew import with_count

W20, W60 = f"WITH {KNN(20)}", f"WITH {KNN(60)}"


def rounded(df):
    return df.select("src", "dst", F.col("rank").cast("long").alias("rank"), r6("score"))


@query("x1_knn", f"WITH {KNN(10)} SELECT src, dst, rank, round(score, 6) AS score FROM knn")
def x1(spark, d):
    return rounded(knn(spark, d, 10))


@query("x4_query_subset", f"WITH {KNN(10)} SELECT src, dst, rank, round(score, 6) AS score FROM knn WHERE src % 50 = 0")
def x4(spark, d):
    e = read(spark, d, "embeddings")
    return rounded(x.knn(e.where("vec_id % 50 = 0"), 10, e))


X5 = f"WITH {VECTORS} SELECT a.id AS left_id, b.id AS right_id, round(greatest(-1, least(1, list_cosine_similarity(a.e, b.e))), 6) AS score FROM v a CROSS JOIN v b WHERE a.id % 50 = 0 AND b.id % 50 = 1"


@query("x5_score_matrix", X5)
def x5(spark, d):
    v = vectors(spark, d)
    return x.score_table(v.where("id % 50 = 0"), v.where("id % 50 = 1")).withColumn("score", F.round("score", 6))


X5_ALL = f"WITH {VECTORS} SELECT a.id AS left_id, b.id AS right_id, round(greatest(-1, least(1, list_cosine_similarity(a.e, b.e))), 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0"


@query("x5_score_matrix_all", X5_ALL)
def x5_all(spark, d):
    v = vectors(spark, d)
    return x.score_blocks(v.where("id % 50 = 0"), v).withColumn("score", F.round("score", 6))


@query("x6_pair_scores", f"WITH {VECTORS} SELECT a.id AS left_id, b.id AS right_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON b.id = a.id + 1")
def x6(spark, d):
    v = vectors(spark, d)
    p = v.select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    return x.pair_scores(p, v).where("score is not null").withColumn("score", F.round("score", 6)).select("left_id", "right_id", "score")


@query("x7_one_to_many", f"WITH {VECTORS} SELECT 'reference-' || lpad(cast(b.id as string), 5, '0') AS reference, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.id = 0 AND b.id <> 0 ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id LIMIT 5")
def x7(spark, d):
    v = vectors(spark, d)
    s = x.top_of(x.score_table(v.where("id = 0"), v.where("id <> 0")), 5)
    return s.select(F.concat(F.lit("reference-"), F.lpad(F.col("right_id").cast("string"), 5, "0")).alias("reference"), r6("score"))


UNIT = "u AS (SELECT id, label, list_transform(e, lambda q: q / sqrt(list_sum(list_transform(e, lambda z: z * z)))) AS e FROM v)"
CENTRES = "c0 AS (SELECT label, i, avg(e[i]) AS m FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS m FROM c0 GROUP BY 1)"


@query("a16_pooled", f"WITH {VECTORS}, {UNIT}, {CENTRES} SELECT label::BIGINT AS label, round(sqrt(list_sum(list_transform(m, lambda z: z * z))), 6) AS length, round(m[1], 6) AS first FROM c")
def a16(spark, d):
    p = x.pooled(vectors(spark, d), "label", last_unit=False)
    return p.select(F.col("label").cast("long").alias("label"), F.round(c.norm(F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@query("a17_max_pooled", f"WITH {VECTORS} SELECT label::BIGINT AS label, round(max(e[1]), 6) AS first, round(max(e[64]), 6) AS last FROM v GROUP BY 1")
def a17(spark, d):
    p = x.pooled(vectors(spark, d), "label", first_unit=False, last_unit=False, how="max")
    return p.select(F.col("label").cast("long").alias("label"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("a24_weighted_average", f"WITH {VECTORS} SELECT i, round(sum(w * e[i]) / sum(w), 6) AS m FROM (SELECT id, e, 1 + id % 3 AS w FROM v), (SELECT unnest(range(1, 65)) AS i) GROUP BY 1")
def a24(spark, d):
    e = vectors(spark, d).select((1 + F.col("id") % 3).alias("w"), F.posexplode("v").alias("p", "z"))
    return e.groupBy((F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.sum(F.col("w") * F.col("z")) / F.sum("w"), 6).alias("m"))


CLS = f"{UNIT}, {CENTRES}, q AS (SELECT id, c.label AS class_id, 10 * list_cosine_similarity(v.e, c.m) AS s FROM v, c), cl AS (SELECT id, class_id, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS prob FROM q), cls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, class_id) AS class_rank FROM cl) WHERE class_rank <= 5)"


@query("x10_class_posteriors", f"WITH {VECTORS}, {CLS} SELECT id, class_rank, class_id::BIGINT AS class_id, round(prob, 6) AS prob FROM cls")
def x10(spark, d):
    p = x.class_posteriors(vectors(spark, d), "label", 5)
    return p.select("id", F.col("class_rank").cast("long").alias("class_rank"), F.col("class_id").cast("long").alias("class_id"), r6("prob"))


@query("x8_verify", f"WITH {VECTORS}, {UNIT}, {CENTRES} SELECT c.label::BIGINT AS owner, v.id, round(list_cosine_similarity(c.m, v.e), 6) AS score, list_cosine_similarity(c.m, v.e) >= 0.1 AS accepted FROM c, v WHERE v.id % 25 = 0")
def x8(spark, d):
    v = vectors(spark, d)
    e = x.pooled(v, "label").select(F.col("label").cast("long").alias("owner"), "v")
    trials = e.select("owner").crossJoin(v.where("id % 25 = 0").select("id"))
    return x.verify(trials, e, v.select("id", "v"), 0.1).select("owner", "id", r6("score"), "accepted")


@query("x11_self_retrieval", f"WITH {VECTORS}, n AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(list_concat(a.e[1:32], list_transform(a.e[33:64], lambda z: z * 0.5)), b.e) DESC, b.id) AS r FROM v a, v b WHERE a.id % 10 = 0) SELECT id, id = other AS found FROM n WHERE r = 1")
def x11(spark, d):
    v = vectors(spark, d)
    bent = v.where("id % 10 = 0").select("id", F.transform("v", lambda z, i: F.when(i < 32, z).otherwise(z * 0.5)).alias("v"))
    best = x.knn(bent.withColumn("id", F.col("id") * 2 + 1), 1, v.select((F.col("id") * 2).alias("id"), "v"), "id", "v")  # ids told apart
    return best.select(((F.col("src") - 1) / 2).cast("long").alias("id"), (F.col("src") - 1 == F.col("dst")).alias("found"))


# --- graph

MUTUAL = "mut AS (SELECT k.* FROM knn k WHERE rank <= 10 AND EXISTS (SELECT 1 FROM knn r WHERE r.rank <= 20 AND r.src = k.dst AND r.dst = k.src))"
SHARED = "sh AS (SELECT m.*, (SELECT count(*) FROM knn a JOIN knn b ON a.dst = b.dst WHERE a.src = m.src AND b.src = m.dst AND a.rank <= 20 AND b.rank <= 20) AS shared FROM mut m)"
Z = "d0 AS (SELECT src AS id, avg(score) AS d FROM knn WHERE rank <= 20 GROUP BY 1), z AS (SELECT id, (d - avg(d) OVER ()) / greatest(stddev_pop(d) OVER (), 1e-6) AS z FROM d0)"
ADJ = "adj AS (SELECT k.src, k.dst, k.score, row_number() OVER (PARTITION BY k.src ORDER BY round(k.score + 0.03 * (r.src IS NOT NULL)::INT - 0.02 * z.z, 12) DESC, k.dst) AS rank FROM knn k JOIN z ON z.id = k.dst LEFT JOIN (SELECT src, dst FROM knn WHERE rank <= 20) r ON r.src = k.dst AND r.dst = k.src WHERE k.rank <= 60)"


@query("g1_mutual", f"{W20}, {MUTUAL} SELECT src, dst FROM mut")
def g1(spark, d):
    return graph.mutual(knn(spark, d, 20), 10, 20).select("src", "dst")


@query("g2_shared_counts", f"{W20}, {MUTUAL}, {SHARED} SELECT src, dst, shared FROM sh")
def g2(spark, d):
    k = knn(spark, d, 20)
    return graph.shared_counts(graph.mutual(k, 10, 20), k, 20).select("src", "dst", "shared")


@query("g3_shared_mask", f"{W20}, {MUTUAL}, {SHARED} SELECT src, dst FROM sh WHERE shared >= 3")
def g3(spark, d):
    return g2(spark, d).where("shared >= 3").select("src", "dst")


@query("g4_density", f"{W20}, {Z} SELECT id, round(z, 6) AS z FROM z")
def g4(spark, d):
    return graph.density_z(knn(spark, d, 20)).select("id", r6("z"))


@query("g5_cluster_edges", f"{W20}, {MUTUAL}, {SHARED}, {Z} SELECT src, dst, round(score + 0.02 / rank + 0.04 * shared / 20 - 0.02 * z, 6) AS weight FROM sh JOIN z ON z.id = dst WHERE shared >= 2")
def g5(spark, d):
    return graph.cluster_edges(knn(spark, d, 20), 10, 20, 20, 2).select("src", "dst", r6("weight"))


@query("v10_quantile_edges", f"{W20} SELECT src, dst FROM knn WHERE rank <= 10 AND score >= (SELECT quantile_cont(score, 0.9) FROM knn WHERE rank <= 10)")
def v10(spark, d):
    k = knn(spark, d, 20).where("rank <= 10")
    bound = quantiles(k, "score", [0.9]).select(F.col("value").alias("b"))
    return k.join(F.broadcast(bound), F.col("score") >= F.col("b")).select("src", "dst")


COMP = "eg AS (SELECT src AS a, dst AS b FROM mut5 UNION SELECT dst, src FROM mut5), comp AS (SELECT id, min(r) AS component FROM (WITH RECURSIVE reach AS (SELECT id, id AS r FROM v UNION SELECT reach.id, eg.b FROM reach JOIN eg ON eg.a = reach.r) SELECT * FROM reach) GROUP BY 1)"
MUT5 = "mut5 AS (SELECT k.src, k.dst FROM knn k WHERE rank <= 3 AND EXISTS (SELECT 1 FROM knn r WHERE r.rank <= 3 AND r.src = k.dst AND r.dst = k.src))"


@query("g6_components", f"{W20}, {MUT5}, {COMP} SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp")
def g6(spark, d):
    p = graph.labelled_nodes(nodes(spark, d), graph.mutual(knn(spark, d, 20), 3, 3))
    return with_count(p, "component", "size").select("id", "component", "size")


@query("g7_label_propagation")
def g7(spark, d):
    e = graph.mutual(knn(spark, d, 20), 10, 20).withColumn("weight", F.col("score"))
    return graph.label_propagation(nodes(spark, d), e, 5)


SYNC = "l0 AS (SELECT id, id AS label FROM v), " + ", ".join(
    f"w{i} AS (SELECT m.src, l.label AS l, round(sum(m.score), 9) AS w FROM mut m JOIN l{i} l ON l.id = m.dst GROUP BY 1, 2), b{i} AS (SELECT src, l FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, l) AS r FROM w{i}) WHERE r = 1), l{i + 1} AS (SELECT l{i}.id, coalesce(b{i}.l, l{i}.label) AS label FROM l{i} LEFT JOIN b{i} ON b{i}.src = l{i}.id)" for i in range(3)
)


@query("g7_synchronous", f"{W20}, {MUTUAL}, {SYNC} SELECT id, label FROM l3")
def g7s(spark, d):
    e = graph.mutual(knn(spark, d, 20), 10, 20).withColumn("weight", F.col("score"))
    return graph.synchronous_propagation(nodes(spark, d), e, 3)


@query("g8_split_oversized")
def g8(spark, d):
    e = graph.mutual(knn(spark, d, 20), 10, 20).withColumn("weight", F.col("score"))
    return graph.split_oversized(graph.label_propagation(nodes(spark, d), e, 5), e, 20, 3)


@query("g10_margin_edges", f"{W20}, mg AS (SELECT src FROM knn GROUP BY src HAVING max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) >= 0.005) SELECT DISTINCT least(k.src, k.dst) AS a, greatest(k.src, k.dst) AS b FROM knn k JOIN knn r ON r.src = k.dst AND r.dst = k.src WHERE k.rank <= 10 AND r.rank <= 10 AND k.src IN (SELECT src FROM mg) AND k.dst IN (SELECT src FROM mg)")
def g10(spark, d):
    return graph.mutual_margin_edges(knn(spark, d, 20), 10, 0.005)


@query("g11_regime_gate", f"{W20}, t AS (SELECT src, dst, score, src % 3 AS regime FROM knn WHERE rank = 1), q AS (SELECT regime, greatest(0.3, quantile_cont(score, 0.5)) AS tau FROM t GROUP BY 1), mut5 AS (SELECT src, dst FROM t JOIN q USING (regime) WHERE score >= tau), {COMP} SELECT id, component FROM comp")
def g11(spark, d):
    t = knn(spark, d, 20).where("rank = 1").withColumn("regime", F.col("src") % 3)
    q = quantiles(t, "score", [0.5], ("regime",)).select("regime", F.greatest(F.lit(0.3), F.col("value")).alias("tau"))
    return graph.labelled_nodes(nodes(spark, d), t.join(F.broadcast(q), "regime").where("score >= tau"))


@query("g12_same_label", f"{W20} SELECT src, count(*) FILTER (a.label = b.label) AS same FROM knn JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE rank <= 10 GROUP BY 1")
def g12(spark, d):
    from tessera.operators.select import same_label_count

    return same_label_count(knn(spark, d, 20), nodes(spark, d), 10)


DEG = "deg AS (SELECT v.id, count(k.src) AS in_degree FROM v LEFT JOIN (SELECT * FROM knn WHERE rank <= 10) k ON k.dst = v.id GROUP BY 1)"


@query("g13_hub_z", f"{W20}, {DEG} SELECT id, round((ln(1 + in_degree) - avg(ln(1 + in_degree)) OVER ()) / greatest(stddev_pop(ln(1 + in_degree)) OVER (), 1e-6), 6) AS z FROM deg")
def g13(spark, d):
    g = graph.in_degree(knn(spark, d, 20), nodes(spark, d), 10).select("id", F.log1p("in_degree").alias("h"))
    s = g.agg(F.avg("h").alias("m"), F.greatest(F.stddev_pop("h"), F.lit(1e-6)).alias("s"))
    return g.join(F.broadcast(s)).select("id", F.round((F.col("h") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("a12_in_degree", f"{W20}, {DEG} SELECT id, in_degree FROM deg")
def a12(spark, d):
    return graph.in_degree(knn(spark, d, 20), nodes(spark, d), 10)


@query("a13_degree_distribution", f"{W20}, {DEG} SELECT in_degree, count(*) AS n FROM deg GROUP BY 1")
def a13(spark, d):
    return a12(spark, d).groupBy("in_degree").agg(F.count("*").alias("n"))


@query("a11_confused_pairs", f"{W20} SELECT a.label::BIGINT AS own, b.label::BIGINT AS their, count(*) AS n FROM knn JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE rank <= 10 AND a.label <> b.label GROUP BY 1, 2")
def a11(spark, d):
    from tessera.operators.metrics import hits

    h = hits(knn(spark, d, 20).where("rank <= 10"), nodes(spark, d))
    return h.where("hit = 0").groupBy(F.col("own").cast("long").alias("own"), F.col("their").cast("long").alias("their")).agg(F.count("*").alias("n"))


@query("w8_row_z", f"{W20} SELECT src, dst, round((score - avg(score) OVER (PARTITION BY src)) / greatest(stddev_pop(score) OVER (PARTITION BY src), 1e-6), 6) AS z FROM knn")
def w8(spark, d):
    w = Window.partitionBy("src")
    return knn(spark, d, 20).select("src", "dst", F.round((F.col("score") - F.avg("score").over(w)) / F.greatest(F.stddev_pop("score").over(w), F.lit(1e-6)), 6).alias("z"))


@query("w9_robust_z", f"{W20}, q AS (SELECT src, median(score) AS m, greatest(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 1e-6) AS s FROM knn GROUP BY 1) SELECT src, dst, round(greatest(-3, least(3, (score - m) / s)), 6) AS z FROM knn JOIN q USING (src)")
def w9(spark, d):
    return rerank.robust_z(knn(spark, d, 20), -3.0, 3.0).select("src", "dst", r6("z"))


@query("w11_margins", f"{W20} SELECT src, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10), 6) AS margin FROM knn GROUP BY 1")
def w11(spark, d):
    return graph.margins(knn(spark, d, 20), 1, 10).select("src", r6("margin"))


# --- re-ranking

@query("r1_adjusted_ranking", f"{W60}, {Z}, {ADJ} SELECT src, dst, rank, round(score, 6) AS score FROM adj WHERE rank <= 10")
def r1(spark, d):
    return rounded(rerank.adjusted_ranking(knn(spark, d, 60), 60).where("rank <= 10"))


PREFER = "pr AS (SELECT a.src, a.dst, a.score, a.rank AS before, s.component = t.component AS same, count(*) FILTER (s.component = t.component) OVER (PARTITION BY a.src) AS n_same, s.size FROM adj a JOIN sized s ON s.id = a.src JOIN sized t ON t.id = a.dst), res AS (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN size BETWEEN 2 AND 120 AND n_same >= 1 AND same THEN 0 ELSE 1 END, before) AS rank FROM pr)"


@query("r4_community_rerank", f"{W60}, {Z}, {ADJ}, {MUT5}, {COMP}, sized AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM comp), {PREFER} SELECT src, dst, rank, round(score, 6) AS score FROM res WHERE rank <= 10")
def r4(spark, d):
    k = knn(spark, d, 60)
    parts = graph.labelled_nodes(nodes(spark, d), graph.mutual(k, 3, 3)).withColumnRenamed("component", "label")
    return rounded(rerank.prefer_group(rerank.adjusted_ranking(k, 60), parts, 10, 2, 120, 1))


@query("r5_propagation_rerank")
def r5(spark, d):
    return rounded(rerank.propagation_rerank(knn(spark, d, 60), nodes(spark, d), rank_top=60))


@query("r6_cluster_first")
def r6q(spark, d):
    return rounded(rerank.cluster_first(knn(spark, d, 60), nodes(spark, d), shared_top=20)[0])


OVER = "ov AS (SELECT k.src, k.dst, k.rank, k.score, coalesce((SELECT sum(p.prob * q.prob) FROM cls p JOIN cls q ON p.class_id = q.class_id WHERE p.id = k.src AND q.id = k.dst AND p.class_rank <= 3 AND q.class_rank <= 3), 0) AS overlap FROM knn k)"
FIRST = "f AS (SELECT id, class_id FROM cls WHERE class_rank = 1)"


@query("r8_class_overlap", f"{W20}, {CLS}, {OVER} SELECT src, dst, round(overlap, 6) AS overlap FROM ov")
def r8(spark, d):
    return rerank.class_overlap(knn(spark, d, 20), x.class_posteriors(vectors(spark, d), "label", 5), 3).select("src", "dst", r6("overlap"))


@query("r7_class_adjusted", f"{W20}, {CLS}, {OVER}, {FIRST}, a AS (SELECT ov.src, ov.dst, ov.score + 0.08 * overlap + 0.03 * (m.class_id = t.class_id)::INT + 0.01 * (EXISTS (SELECT 1 FROM cls WHERE cls.id = ov.src AND class_rank <= 3 AND cls.class_id = t.class_id))::INT AS score FROM ov JOIN f m ON m.id = ov.src JOIN f t ON t.id = ov.dst) SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(score, 12) DESC, dst) AS rank, round(score, 6) AS score FROM a")
def r7(spark, d):
    return rounded(rerank.class_adjusted(knn(spark, d, 20), x.class_posteriors(vectors(spark, d), "label", 5)))


@query("r9_class_first", f"{W60}, {CLS}, {FIRST}, n AS (SELECT k.src, k.dst, k.rank, k.score, t.class_id IN (SELECT class_id FROM cls WHERE cls.id = k.src AND class_rank <= 3) AS fits, m.class_id = t.class_id AS same FROM knn k JOIN f m ON m.id = k.src JOIN f t ON t.id = k.dst), g AS (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY src) AS held FROM n), o AS (SELECT g.*, coalesce((SELECT sum(p.prob * q.prob) FROM cls p JOIN cls q ON p.class_id = q.class_id WHERE p.id = g.src AND q.id = g.dst), 0) AS overlap FROM g), p AS (SELECT src, dst, rank AS near, fits AND held >= 3 AS first, CASE WHEN fits AND held >= 3 THEN 0.5 * score + 0.35 * overlap + 0.15 * same::INT + 0.03 / rank ELSE score END AS score FROM o) SELECT src, dst, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY first DESC, CASE WHEN first THEN 0 ELSE near END, round(score, 12) DESC, dst) AS rank FROM p) WHERE rank <= 10")
def r9(spark, d):
    v = vectors(spark, d)
    return rounded(rerank.class_first(knn(spark, d, 60), x.class_posteriors(v, "label", 5), v, rerank.ClassFirst(backfill=False)))


@query("r9_class_first_backfill")
def r9_backfill(spark, d):
    v = vectors(spark, d)
    return rounded(rerank.class_first(knn(spark, d, 60), x.class_posteriors(v, "label", 5), v))


def half(spark, d, side: str, k: int):
    e = read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1 if side == "left" else 33, 32).alias("embedding"))
    return graph.cut(x.knn(e, k))


def HALF(name: str, span: str) -> str:
    return f"{name}0 AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.e{span}, b.e{span}) AS score FROM v a JOIN v b ON a.id <> b.id), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM {name}0) WHERE rank <= 20)"


PART = "SELECT k.src, k.dst, {w} * greatest(0.7 * (1 - (rank - 1) / 19e0) + 0.3 * greatest(-3, least(3, (score - m) / s)), 0) AS part FROM {n} k JOIN (SELECT src, median(score) AS m, greatest(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 1e-6) AS s FROM {n} GROUP BY 1) q USING (src)"


@query("r10_fusion", f"WITH {VECTORS}, {HALF('l', '[1:32]')}, {HALF('r', '[33:64]')}, f AS (SELECT src, dst, sum(part) AS score FROM ({PART.format(w=0.6, n='l')} UNION ALL {PART.format(w=0.4, n='r')}) GROUP BY 1, 2) SELECT src, dst, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 12) DESC, dst) AS rank FROM f) WHERE rank <= 10")
def r10(spark, d):
    return rounded(rerank.fuse([(half(spark, d, "left", 20), 0.6), (half(spark, d, "right", 20), 0.4)], 10, 20))


TEACH = "SELECT n.src, n.dst, {w} * (0.1 * n.z + n.score + 0.2 / sqrt(n.rank) + 0.03 * (b.src IS NOT NULL)::INT - 0.02 * h.hub) AS part FROM (SELECT *, (score - avg(score) OVER (PARTITION BY src)) / greatest(stddev_pop(score) OVER (PARTITION BY src), 1e-6) AS z FROM {n}) n LEFT JOIN {n} b ON b.src = n.dst AND b.dst = n.src JOIN (SELECT dst, (g - avg(g) OVER ()) / greatest(stddev_pop(g) OVER (), 1e-6) AS hub FROM (SELECT dst, ln(1 + count(*)) AS g FROM {n} GROUP BY 1)) h ON h.dst = n.dst"


@query("r11_teacher_fusion", f"WITH {VECTORS}, {HALF('l', '[1:32]')}, {HALF('r', '[33:64]')}, f AS (SELECT src, dst, sum(part) + 0.05 * (count(*) - 1) AS score, count(*) AS seen FROM ({TEACH.format(w=0.6, n='l')} UNION ALL {TEACH.format(w=0.4, n='r')}) GROUP BY 1, 2) SELECT src, dst, rank, round(score, 6) AS score, seen FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 12) DESC, seen DESC, dst) AS rank FROM f) WHERE rank <= 10")
def r11(spark, d):
    t = rerank.fuse_teachers([(half(spark, d, "left", 20), 0.6), (half(spark, d, "right", 20), 0.4)], 10, 20)
    return t.select("src", "dst", F.col("rank").cast("long").alias("rank"), r6("score"), "seen")


def policies(spark, d):
    k = knn(spark, d, 60)
    named = [("exact", k), ("full_c4", rerank.adjusted_ranking(k, 60)), ("left", half(spark, d, "left", 20))]
    out = None
    for name, ranking in named:
        part = ranking.where("rank <= 10").select(F.lit(name).alias("policy"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


POL = f"{W60}, {Z}, {ADJ}, {HALF('l', '[1:32]')}, pol AS (SELECT 'exact' AS policy, src, dst FROM knn WHERE rank <= 10 UNION ALL SELECT 'full_c4', src, dst FROM adj WHERE rank <= 10 UNION ALL SELECT 'left', src, dst FROM l WHERE rank <= 10)"


@query("r12_consensus", f"{POL} SELECT policy, src, round(sum(votes) / 30, 6) AS consensus FROM (SELECT *, count(*) OVER (PARTITION BY src, dst) AS votes FROM pol) GROUP BY 1, 2")
def r12(spark, d):
    return rerank.consensus(policies(spark, d), 10).select("policy", "src", r6("consensus"))


@query("r13_overlap", f"{POL} SELECT p.policy, p.src, count(f.dst) AS overlap FROM pol p LEFT JOIN (SELECT * FROM pol WHERE policy = 'full_c4') f ON f.src = p.src AND f.dst = p.dst GROUP BY 1, 2")
def r13(spark, d):
    return rerank.overlaps(policies(spark, d), "full_c4")


R14 = "f AS (SELECT vec_id AS src, (vec_id % 10) / 1e2 AS margin, vec_id % 6 AS support, vec_id % 160 AS label_size, vec_id % 9 AS same_label, vec_id % 4 <> 0 AS usable, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id % 11) / 1e1 END AS entropy, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE (vec_id % 40) / 1e1 END AS duration, vec_id % 11 AS overlap_classaware, vec_id % 8 AS overlap_weak, (vec_id % 7) / 1e2 AS consensus_soup, 2e-2 AS consensus_full FROM embeddings)"
ROUTE = """WITH {f}, g AS (SELECT *, NOT usable OR margin < 0.015 OR support <= 1 OR same_label < 3 OR label_size > 95 AS suspicious, label_size > 140 OR support = 0 OR coalesce(duration < 2 AND margin < 0.045, false) AS extreme, usable AND margin >= 0.045 AND support >= 3 AND same_label >= 6 AND label_size <= 95 AS strong FROM f)
  SELECT src, CASE WHEN entropy <= 0.55 AND overlap_classaware >= 5 AND NOT extreme THEN 'low_entropy_classaware_agreement' WHEN strong AND (entropy IS NULL OR entropy <= 0.85) AND overlap_classaware >= 7 THEN 'strong_graph_classaware_agreement'
  WHEN NOT suspicious AND consensus_soup - consensus_full >= 0.02 THEN 'soup_consensus_advantage' WHEN suspicious AND extreme THEN 'extreme_low_graph_confidence_exact' WHEN suspicious AND overlap_weak >= 5 THEN 'weak_c4_low_graph_confidence' WHEN suspicious THEN 'reciprocal_low_graph_confidence'
  WHEN strong THEN 'strong_graph_full_c4' ELSE 'default_policy' END AS reason FROM g"""


@query("r14_router", ROUTE.format(f=R14))
def r14(spark, d):
    read(spark, d, "embeddings").createOrReplaceTempView("_embeddings")
    rows = spark.sql(R14.replace("f AS (", "", 1)[:-1].replace("FROM embeddings", "FROM _embeddings"))
    return rerank.route(rows, {"classaware", "soup", "exact", "weak", "reciprocal"}).select("src", "reason")


@query("entropy_normalised", f"WITH {VECTORS}, {CLS}, t AS (SELECT id, prob / sum(prob) OVER (PARTITION BY id) AS p FROM cls) SELECT id, round(-sum(p * ln(greatest(p, 1e-12))) / ln(5), 6) AS entropy FROM t GROUP BY 1")
def entropy(spark, d):
    p = x.class_posteriors(vectors(spark, d), "label", 5).groupBy("id").agg(F.collect_list("prob").alias("p"))
    return p.select("id", F.round(c.normalised_entropy(F.col("p")), 6).alias("entropy"))


# --- exports

@query("k1_submission", f"{W20} SELECT src AS row_index, string_agg(cast(dst as string), ',' ORDER BY rank) AS neighbours FROM knn WHERE rank <= 10 GROUP BY 1")
def k1(spark, d):
    manifest = nodes(spark, d).select(F.col("id").alias("row_index"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("filepath"))
    return sinks.submission_rows(knn(spark, d, 20), manifest, 10).select("row_index", "neighbours")


@query("k2_clusters", f"{W20}, {MUT5}, {COMP} SELECT 'f' || cast(id as string) AS filepath, id AS row_index, component AS cluster_id, count(*) OVER (PARTITION BY component) AS cluster_size FROM comp")
def k2(spark, d):
    manifest = nodes(spark, d).select(F.col("id").alias("row_index"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("filepath"))
    labels = graph.labelled_nodes(nodes(spark, d), graph.mutual(knn(spark, d, 20), 3, 3)).withColumnRenamed("component", "label")
    return sinks.cluster_rows(labels, manifest)


@query("k13_wide", f"{W20} SELECT src, max(dst) FILTER (rank = 1) AS neighbor_1, round(max(score) FILTER (rank = 1), 6) AS score_1, max(dst) FILTER (rank = 2) AS neighbor_2, round(max(score) FILTER (rank = 2), 6) AS score_2, max(dst) FILTER (rank = 3) AS neighbor_3, round(max(score) FILTER (rank = 3), 6) AS score_3 FROM knn GROUP BY 1")
def k13(spark, d):
    w = sinks.wide(knn(spark, d, 20), 3)
    return w.select("src", *[F.round(n, 6).alias(n) if n.startswith("score") else n for n in w.columns[1:]])


@query("k12_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def k12(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    return sinks.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")
