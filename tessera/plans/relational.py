"""Queries over tables: buckets, validation, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import profile, vectors
from tessera.operators.quantiles import quantile_columns, quantiles
from tessera.plans.base import FILES, files, query, r6, read
from tessera.sources import schema

WF = f"WITH {FILES} "


def case(col, edges, labels, null=None, op="<"):
    head = f"CASE WHEN {col} IS NULL THEN '{null}' " if null else "CASE "
    return head + " ".join(f"WHEN {col} {op} {e} THEN '{x}'" for e, x in zip(edges, labels, strict=False)) + f" ELSE '{labels[-1]}' END"


@query("p1_duration_bucket", WF + f"SELECT row_index, {case('duration_s', c.DURATION_EDGES, c.DURATION_LABELS, 'unknown')} AS bucket FROM files")
def p1(spark, d):
    return files(spark, d).select("row_index", c.duration_bucket(F.col("duration_s")).alias("bucket"))


@query("p2_silence_bucket", WF + f"SELECT row_index, {case('silence_ratio_40db', c.SILENCE_EDGES, c.SILENCE_LABELS, 'unknown')} AS bucket FROM files")
def p2(spark, d):
    return files(spark, d).select("row_index", c.silence_bucket(F.col("silence_ratio_40db")).alias("bucket"))


@query("p3_narrowband_bucket", WF + f"SELECT row_index, {case('narrowband_proxy', c.NARROW_EDGES, c.NARROW_LABELS, 'unknown')} AS bucket FROM files")
def p3(spark, d):
    return files(spark, d).select("row_index", c.narrowband_bucket(F.col("narrowband_proxy")).alias("bucket"))


@query("p4_length_bucket", WF + f"SELECT row_index, {case('duration_s', c.LENGTH_EDGES, c.LENGTH_LABELS)} AS bucket FROM files")
def p4(spark, d):
    return files(spark, d).select("row_index", c.length_bucket(F.col("duration_s")).alias("bucket"))


@query("p5_rms_bucket", WF + f"SELECT row_index, {case('rms_dbfs', c.RMS_EDGES, c.RMS_LABELS, op='<=')} AS bucket FROM files")
def p5(spark, d):
    return files(spark, d).select("row_index", c.rms_bucket(F.col("rms_dbfs")).alias("bucket"))


@query("p6_edge_silence_bucket", WF + f"SELECT row_index, {case('silence_ratio_40db * 2', c.EDGE_SILENCE_EDGES, c.EDGE_SILENCE_LABELS)} AS bucket FROM files")
def p6(spark, d):
    return files(spark, d).select("row_index", c.edge_silence_bucket(F.col("silence_ratio_40db") * 2).alias("bucket"))


DOMAIN = """CASE WHEN error IS NOT NULL THEN 'read_error' WHEN duration_s IS NULL AND rms_dbfs IS NULL THEN 'not_profiled' WHEN duration_s < 2 THEN 'short'
  WHEN clipping_frac >= 0.01 OR peak_dbfs >= -0.1 THEN 'clipped' WHEN silence_ratio_40db >= 0.5 THEN 'silence_heavy' WHEN rms_dbfs <= -40 THEN 'low_volume'
  WHEN narrowband_proxy >= 0.5 OR rolloff95_hz <= 3800 THEN 'narrowband_like' WHEN spectral_flatness >= 0.35 AND rms_dbfs >= -35 THEN 'noise_like' ELSE 'cleanish' END"""
WD = f"WITH {FILES}, dom AS (SELECT *, {DOMAIN} AS domain_cluster FROM files) "


def domains(spark, d):
    return files(spark, d).withColumn("domain_cluster", c.domain_cluster())


@query("p7_domain_cluster", WD + "SELECT row_index, domain_cluster FROM dom")
def p7(spark, d):
    return domains(spark, d).select("row_index", "domain_cluster")


@query("p8_quality_flags", WF + """SELECT row_index, peak_dbfs >= -0.1 AS peak_limited_flag, clipping_frac > 0.01 AS hard_clipped_flag, narrowband_proxy >= 0.5 OR rolloff95_hz <= 3800 AS narrowband_like_flag,
  silence_ratio_40db >= 0.5 AS silence_heavy_flag, rms_dbfs <= -40 AS low_rms_flag FROM files""")
def p8(spark, d):
    return files(spark, d).select("row_index", *[e.alias(n) for n, e in c.quality_flags().items()])


DIST = "2e0 * ((silence_ratio_40db - 0.5) / 0.25) ** 2 + 1e0 * ((spectral_flatness - 0.4) / 0.2) ** 2"


def distance():
    return c.weighted_distance(["silence_ratio_40db", "spectral_flatness"], {"silence_ratio_40db": 0.5, "spectral_flatness": 0.4}, {"silence_ratio_40db": 0.25, "spectral_flatness": 0.2}, {"silence_ratio_40db": 2.0, "spectral_flatness": 1.0})


@query("p9_regimes", WF + f"SELECT row_index, CASE WHEN duration_s < 3 THEN 'short' WHEN duration_s <= 6 THEN 'medium' ELSE 'long' END AS duration_regime, CASE WHEN {DIST} <= 3 THEN 'near' ELSE 'far' END AS profile_regime FROM files")
def p9(spark, d):
    long = F.when(F.col("duration_s") < 3, "short").when(F.col("duration_s") <= 6, "medium").otherwise("long")
    return files(spark, d).select("row_index", long.alias("duration_regime"), F.when(distance() <= 3, "near").otherwise("far").alias("profile_regime"))


@query("p10_count_bins", "SELECT user_id, n, CASE WHEN n < 50 THEN '<50' WHEN n < 60 THEN '50-59' WHEN n < 70 THEN '60-69' ELSE '70+' END AS bin FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def p10(spark, d):
    n = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", c.count_bin(F.col("n"), (50, 60, 70)).alias("bin"))


QS = "[0.25, 0.5, 0.75]"


@query("p11_quantile_bins", f"WITH q AS (SELECT list_distinct(quantile_cont(value, {QS})) AS e FROM events) SELECT event_id, len(list_filter(e, lambda x: x <= value))::BIGINT AS bin FROM events, q")
def p11(spark, d):
    e = read(spark, d, "events")
    edges = quantiles(e, "value", [0.25, 0.5, 0.75]).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda x: x["value"])).alias("e"))
    return e.join(F.broadcast(edges)).select("event_id", c.bin_of(F.col("value"), F.col("e"), True).cast("long").alias("bin"))


@query("p12_cut_bins", f"WITH q AS (SELECT list_distinct(quantile_cont(value, {QS})) AS e FROM events) SELECT event_id, len(list_filter(e, lambda x: x < value))::BIGINT AS bin FROM events, q")
def p12(spark, d):
    e = read(spark, d, "events")
    edges = quantiles(e, "value", [0.25, 0.5, 0.75]).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda x: x["value"])).alias("e"))
    return e.join(F.broadcast(edges)).select("event_id", c.bin_of(F.col("value"), F.col("e"), False).cast("long").alias("bin"))


@query("p13_distance", WF + f"SELECT row_index, round({DIST}, 6) AS distance FROM files")
def p13(spark, d):
    return files(spark, d).select("row_index", F.round(distance(), 6).alias("distance"))


@query("p14_null_fill", "SELECT doc_id, NULL::DOUBLE AS snr_db, NULL::VARCHAR AS device, source FROM documents")
def p14(spark, d):
    return schema.with_defaults(read(spark, d, "documents").select("doc_id", "source"), {"snr_db": "double", "device": "string", "source": "string"})


@query("p15_recode", WD + "SELECT row_index AS id, CASE WHEN domain_cluster = 'clipped' THEN 'peak_limited' ELSE domain_cluster END AS domain FROM dom")
def p15(spark, d):
    return domains(spark, d).select("row_index", "domain_cluster").withColumnsRenamed({"row_index": "id", "domain_cluster": "domain"}).withColumn("domain", F.when(F.col("domain") == "clipped", "peak_limited").otherwise(F.col("domain")))


@query("p17_flatten", "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def p17(spark, d):
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


STATS = "count(value) AS count, round(avg(value), 8) AS mean, round(min(value), 8) AS min, round(quantile_cont(value, 0.1), 8) AS p10, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.9), 8) AS p90, round(quantile_cont(value, 0.99), 8) AS p99, round(max(value), 8) AS max"
LONG = "long AS (SELECT split, 'duration_s' AS metric, duration_s AS value FROM files UNION ALL SELECT split, 'rms_dbfs', rms_dbfs FROM files UNION ALL SELECT split, 'narrowband_proxy', narrowband_proxy FROM files)"


@query("p18_melt", WF + f", {LONG}, s AS (SELECT split, metric, {STATS} FROM long GROUP BY 1, 2) SELECT split, metric || '.' || name AS metric_field, value FROM (UNPIVOT (SELECT split, metric, mean, p50, max FROM s) ON mean, p50, max INTO NAME name VALUE value)")
def p18(spark, d):
    s = profile.long_summary(files(spark, d), "split", ["duration_s", "rms_dbfs", "narrowband_proxy"]).select("split", "metric", "mean", "p50", "max")
    return s.unpivot(["split", "metric"], ["mean", "p50", "max"], "name", "value").select("split", F.concat_ws(".", "metric", "name").alias("metric_field"), "value")


@query("p19_align", WF + "SELECT a.lang AS lang, round(a.m, 6) AS local, round(b.m, 6) AS public, round(b.m - a.m, 6) AS diff, round(b.m / a.m, 6) AS ratio FROM (SELECT lang, avg(duration_s) m FROM files WHERE split = 'train' GROUP BY 1) a JOIN (SELECT lang, avg(duration_s) m FROM files WHERE split = 'test' GROUP BY 1) b USING (lang)")
def p19(spark, d):
    m = lambda s, n: files(spark, d).where(F.col("split") == s).groupBy("lang").agg(F.avg("duration_s").alias(n))
    j = m("train", "a").join(m("test", "b"), "lang")
    return j.select("lang", r6("a", "local"), r6("b", "public"), F.round(F.col("b") - F.col("a"), 6).alias("diff"), F.round(F.col("b") / F.col("a"), 6).alias("ratio"))


@query("p20_severity", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS severity FROM orders")
def p20(spark, d):
    return read(spark, d, "orders").select("o_orderkey", c.recode(F.col("o_orderpriority"), {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}, "medium").alias("severity"))


# --- validation

ROWS = """rows AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS dataset, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS speaker_id, concat('a/', cast(doc_id as string)) AS audio_path,
  CASE WHEN doc_id % 13 = 0 THEN '0.9' ELSE '1.0' END AS schema_version, 'utterance' AS record_type, CASE WHEN doc_id % 5 = 0 THEN 'x' WHEN doc_id % 6 = 0 THEN '-1' ELSE cast(n_chars as string) END AS duration_seconds, '16000' AS sample_rate_hz, CAST(NULL AS string) AS num_channels FROM documents)"""


def manifest_rows(spark, d):
    read(spark, d, "documents").createOrReplaceTempView("_documents")
    return spark.sql(ROWS.replace("rows AS (", "").rstrip(")").replace("FROM documents", "FROM _documents"))


ISSUE_SQL = f"""WITH {ROWS} SELECT row_id, 'dataset' AS field, 'missing_field' AS code FROM rows WHERE nullif(trim(dataset), '') IS NULL
  UNION ALL SELECT row_id, 'speaker_id', 'missing_field' FROM rows WHERE nullif(trim(speaker_id), '') IS NULL
  UNION ALL SELECT row_id, 'schema_version', 'invalid_value' FROM rows WHERE schema_version <> '1.0'
  UNION ALL SELECT row_id, 'duration_seconds', 'invalid_type' FROM rows WHERE try_cast(duration_seconds AS DOUBLE) IS NULL
  UNION ALL SELECT row_id, 'duration_seconds', 'invalid_value' FROM rows WHERE try_cast(duration_seconds AS DOUBLE) <= 0"""


@query("v1_manifest_issues", ISSUE_SQL)
def v1(spark, d):
    return manifest_rows(spark, d).select("row_id", F.inline(schema.issues()))


@query("v2_normalise", "SELECT doc_id, (doc_id % 3 + 1)::INT AS num_channels, n_chars / 1e1 AS snr_db, cast(doc_id % 9 as string) AS session_id, CASE doc_id % 3 WHEN 0 THEN 'mono' WHEN 1 THEN 'stereo' ELSE 'multichannel' END AS channel FROM documents")
def v2(spark, d):
    old = read(spark, d, "documents").selectExpr("doc_id", "doc_id % 3 + 1 AS channels", "n_chars / 1e1 AS snr", "doc_id % 9 AS session_index")
    return schema.normalise_manifest(old).select("doc_id", "num_channels", "snr_db", "session_id", "channel")


@query("v3_report", f"WITH i AS ({ISSUE_SQL}) SELECT field, code, count(*) AS n FROM i GROUP BY 1, 2")
def v3(spark, d):
    return v1(spark, d).groupBy("field", "code").agg(F.count("*").alias("n"))


SUB = """sub AS (SELECT doc_id AS row_index, concat('doc/', cast(doc_id as string)) AS filepath, CASE WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 = 2 THEN concat(cast(doc_id as string), ',1') WHEN doc_id % 10 = 3 THEN '4,4'
  WHEN doc_id % 10 = 4 THEN 'x,5' WHEN doc_id % 10 = 5 THEN '1,2,3' WHEN doc_id % 10 = 6 THEN '999999999,7' WHEN doc_id % 10 = 7 THEN '1,' ELSE '1000000,1' END AS neighbours FROM documents WHERE doc_id % 17 <> 0)"""
V4 = f"""WITH {SUB}, t AS (SELECT doc_id AS row_index, concat(CASE WHEN doc_id % 23 = 0 THEN 'x/' ELSE 'doc/' END, cast(doc_id as string)) AS path FROM documents), n AS (SELECT count(*) AS n FROM t),
  b AS (SELECT row_index, filepath, path, neighbours, string_split(coalesce(neighbours, ''), ',') AS items FROM sub FULL JOIN t USING (row_index)),
  x AS (SELECT *, list_transform(items, lambda i: try_cast(trim(i) AS BIGINT)) AS nums, filepath IS NOT NULL AND path IS NOT NULL AS ok, nullif(trim(neighbours), '') IS NOT NULL AS listed FROM b)
  SELECT row_index, 'row_count' AS issue FROM x WHERE filepath IS NULL OR path IS NULL UNION ALL SELECT row_index, 'path' FROM x WHERE ok AND filepath <> path UNION ALL SELECT row_index, 'empty' FROM x WHERE ok AND NOT listed
  UNION ALL SELECT row_index, 'count' FROM x WHERE ok AND listed AND len(items) <> 2 UNION ALL SELECT row_index, 'blank' FROM x WHERE ok AND listed AND len(list_filter(items, lambda i: trim(i) = '')) > 0
  UNION ALL SELECT row_index, 'number' FROM x WHERE ok AND listed AND len(list_filter(items, lambda i: trim(i) <> '' AND try_cast(trim(i) AS BIGINT) IS NULL)) > 0
  UNION ALL SELECT row_index, 'repeated' FROM x WHERE ok AND listed AND len(items) = 2 AND nums[1] = nums[2] UNION ALL SELECT row_index, 'self' FROM x WHERE ok AND listed AND list_contains(nums, row_index)
  UNION ALL SELECT row_index, 'range' FROM x, n WHERE ok AND listed AND len(list_filter(nums, lambda i: i < 0 OR i >= n.n)) > 0"""


@query("v4_submission_issues", V4)
def v4(spark, d):
    docs = read(spark, d, "documents")
    docs.createOrReplaceTempView("_documents")
    sub = spark.sql(SUB.replace("sub AS (", "", 1)[:-1].replace("FROM documents", "FROM _documents"))
    template = docs.selectExpr("doc_id AS row_index", "concat(CASE WHEN doc_id % 23 = 0 THEN 'x/' ELSE 'doc/' END, cast(doc_id as string)) AS filepath")
    return schema.submission_issues(sub, template, 2)


@query("v5_metadata_filter", "SELECT doc_id FROM documents WHERE lower(coalesce(lang, '')) IN ('en', 'de') AND lower(coalesce(source, '')) IN ('src1', 'src2')")
def v5(spark, d):
    return schema.metadata_filter(read(spark, d, "documents"), {"lang": ["EN", "de"], "source": ["SRC1", "src2"], "split": []}).select("doc_id")


@query("v6_overlap", "SELECT doc_id FROM documents WHERE NOT (cast(doc_id as string) IN (SELECT cast(doc_id as string) FROM labels) OR source IN ('src3'))")
def v6(spark, d):
    taken = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key")).unionByName(spark.createDataFrame([("src3",)], "key string"))
    return schema.without_overlap(read(spark, d, "documents").select("doc_id", "source"), "doc_id", F.array(F.col("doc_id").cast("string"), F.col("source")), taken, True).select("doc_id")


@query("v7_disjoint", "SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 1")
def v7(spark, d):
    docs = read(spark, d, "documents")
    return docs.where("doc_id % 2 = 0").select("source").intersect(docs.where("doc_id % 2 = 1").select("source"))


@query("v8_vector_faults", "SELECT vec_id AS id, CASE vec_id % 50 WHEN 1 THEN 'empty' WHEN 2 THEN 'zero' WHEN 3 THEN 'size' ELSE 'not_finite' END AS fault FROM embeddings WHERE vec_id % 50 IN (1, 2, 3, 4)")
def v8(spark, d):
    e = read(spark, d, "embeddings").withColumn("embedding", F.expr("CASE vec_id % 50 WHEN 1 THEN array() WHEN 2 THEN transform(embedding, x -> CAST(0 AS float)) WHEN 3 THEN slice(embedding, 1, 10) WHEN 4 THEN transform(embedding, x -> CAST('NaN' AS float)) ELSE embedding END"))
    return schema.vector_faults(e, "vec_id", "embedding")


@query("v9_score_checks", "SELECT count(*) AS n, count(*) FILTER (quality IN (0, 1)) AS binary_labels, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM labels")
def v9(spark, d):
    q = F.col("quality")
    return read(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(q.isin(0, 1)).alias("binary_labels"), F.count_if(q == 1).alias("positives"), F.count_if(q == 0).alias("negatives"))


@query("v11_gates", WF + "SELECT count(*) AS rows_in, count(*) FILTER (duration_s >= 5) AS long_enough, count(*) FILTER (duration_s >= 5 AND rms_dbfs > -40) AS loud_enough, count(*) FILTER (duration_s >= 5 AND rms_dbfs > -40 AND narrowband_proxy < 0.5) AS wide_enough FROM files")
def v11(spark, d):
    return schema.gates(files(spark, d), [("long_enough", F.col("duration_s") >= 5), ("loud_enough", F.col("rms_dbfs") > -40), ("wide_enough", F.col("narrowband_proxy") < 0.5)])


@query("v12_alignment", "(SELECT doc_id, 'left' AS side FROM documents WHERE doc_id % 10 <> 3 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 4)) UNION ALL (SELECT doc_id, 'right' FROM documents WHERE doc_id % 10 <> 4 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3))")
def v12(spark, d):
    ids = read(spark, d, "documents").select("doc_id")
    a, b = ids.where("doc_id % 10 <> 3"), ids.where("doc_id % 10 <> 4")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# --- joins

@query("j1_left_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def j1(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("j2_multiway", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j2(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("j4_full_outer", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.lang, b.quality::BIGINT AS quality FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) a FULL JOIN labels b ON a.doc_id = b.doc_id")
def j4(spark, d):
    return read(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id", "full")


@query("j5_semi_anti", "SELECT doc_id, 'semi' AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'anti' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels")
    return docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").withColumn("kind", F.lit("semi")).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("kind", F.lit("anti")))


@query("j6_one_to_one", "SELECT doc_id, lang, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id)")
def j6(spark, d):
    return schema.one_to_one(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id")


@query("j8_first_alias", "WITH k AS (SELECT page_id AS id, 0 AS kind, url AS key FROM pages UNION ALL SELECT page_id, 1, regexp_extract(url, '[^/]*$') FROM pages) SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id, kind) AS r FROM k WHERE key IS NOT NULL) WHERE r = 1")
def j8(spark, d):
    return schema.first_alias(read(spark, d, "pages"), "page_id", [F.col("url"), F.element_at(F.split("url", "/"), -1)])


@query("j9_enrol_test", "SELECT a.s_suppkey AS enrol, b.s_suppkey AS test FROM supplier a CROSS JOIN supplier b WHERE a.s_suppkey % 10 = 0 AND b.s_suppkey % 10 = 1 AND a.s_nationkey <> b.s_nationkey")
def j9(spark, d):
    s = read(spark, d, "supplier")
    a, b = s.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("enrol"), F.col("s_nationkey").alias("x")), s.where("s_suppkey % 10 = 1").select(F.col("s_suppkey").alias("test"), F.col("s_nationkey").alias("y"))
    return a.join(b, F.col("x") != F.col("y")).select("enrol", "test")


@query("j9_enrol_test_all", "SELECT a.s_suppkey AS enrol, b.s_suppkey AS test FROM supplier a CROSS JOIN supplier b WHERE a.s_suppkey % 10 = 0 AND a.s_suppkey <> b.s_suppkey")
def j9_all(spark, d):
    s = read(spark, d, "supplier")
    a, b = s.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("enrol")), s.select(F.col("s_suppkey").alias("test"))
    return vectors.in_blocks(a, b, "enrol", "test").where("enrol <> test")


@query("j14_lookup", "SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def j14(spark, d):
    small = read(spark, d, "nation").where("n_regionkey < 3")
    return read(spark, d, "supplier").join(small, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


# --- aggregates

A1 = """SELECT speaker_id, count(*) AS n_utts, round(sum(duration_s), 6) AS total_duration_s, round(avg(duration_s), 6) AS mean_duration_s, round(stddev_samp(duration_s), 6) AS std_duration_s, round(min(duration_s), 6) AS min_duration_s, round(max(duration_s), 6) AS max_duration_s,
  round(avg((duration_s < 2)::INT), 6) AS short_utt_frac, round(avg((silence_ratio_40db >= 0.5 OR clipping_frac >= 0.01 OR rms_dbfs <= -40)::INT), 6) AS bad_audio_frac, mode(sample_rate_hz ORDER BY sample_rate_hz) AS mode_sample_rate_hz FROM files WHERE speaker_id IS NOT NULL GROUP BY 1"""


@query("a1_speaker_stats", WF + A1.replace("mode(sample_rate_hz ORDER BY sample_rate_hz)", "(SELECT g.sample_rate_hz FROM (SELECT speaker_id AS s, sample_rate_hz, count(*) AS n FROM files GROUP BY 1, 2) g WHERE g.s = files.speaker_id ORDER BY n DESC, sample_rate_hz LIMIT 1)"))
def a1(spark, d):
    s = profile.speaker_stats(files(spark, d))
    return s.select("speaker_id", "n_utts", *[r6(x) for x in ("total_duration_s", "mean_duration_s", "std_duration_s", "min_duration_s", "max_duration_s", "short_utt_frac", "bad_audio_frac")], "mode_sample_rate_hz")


@query("a2_review_stats", WF + "SELECT speaker_id, count(*) AS n, round(median(duration_s), 6) AS median_s, round(100 * avg((clipping_frac > 0.01)::INT), 6) AS clipped_pct, round(100 * avg((silence_ratio_40db >= 0.5)::INT), 6) AS silent_pct FROM files GROUP BY 1")
def a2(spark, d):
    pct = lambda t: F.round(100 * F.avg(t.cast("int")), 6)
    return files(spark, d).groupBy("speaker_id").agg(F.count("*").alias("n"), F.round(F.median("duration_s"), 6).alias("median_s"), pct(F.col("clipping_frac") > 0.01).alias("clipped_pct"), pct(F.col("silence_ratio_40db") >= 0.5).alias("silent_pct"))


@query("a3_dataset_summary", WF + "SELECT coalesce(split, 'all') AS split, count(*) AS n, count(error) AS errors, round(sum(duration_s) / 3600, 6) AS hours, round(quantile_cont(duration_s, 0.1), 6) AS p10, round(quantile_cont(duration_s, 0.9), 6) AS p90 FROM files GROUP BY GROUPING SETS ((split), ())")
def a3(spark, d):
    both = files(spark, d).select(F.explode(F.array("split", F.lit("all"))).alias("split"), "error", "duration_s")
    n = both.groupBy("split").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.round(F.sum("duration_s") / 3600, 6).alias("hours"))
    ends = quantile_columns(both, {"p10": ("duration_s", 0.1), "p90": ("duration_s", 0.9)}, ("split",))
    return n.join(ends, "split", "left").select("split", "n", "errors", "hours", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query("a4_numeric_summary", WF + f", {LONG} SELECT split, metric, {STATS} FROM long GROUP BY 1, 2")
def a4(spark, d):
    return profile.long_summary(files(spark, d), "split", ["duration_s", "rms_dbfs", "narrowband_proxy"])


@query("a5_histogram", WF + f"SELECT {case('duration_s', c.DURATION_EDGES, c.DURATION_LABELS, 'unknown')} AS bucket, count(*) AS n FROM files GROUP BY 1")
def a5(spark, d):
    return files(spark, d).groupBy(c.duration_bucket(F.col("duration_s")).alias("bucket")).agg(F.count("*").alias("n"))


@query("a6_domain_summary", WD + "SELECT domain_cluster, count(*) AS n, round(avg(duration_s), 6) AS mean_duration_s, round(avg(rms_dbfs), 6) AS mean_rms_dbfs FROM dom GROUP BY 1")
def a6(spark, d):
    df = domains(spark, d)
    return df.groupBy("domain_cluster").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in ("duration_s", "rms_dbfs", "absent_metric") if m in df.columns])


@query("a7_breakdown", WD + "SELECT 'lang' AS bucket_name, lang AS bucket_value, count(*) AS n, round(avg(duration_s), 6) AS mean_s FROM dom GROUP BY 2 UNION ALL SELECT 'domain_cluster', domain_cluster, count(*), round(avg(duration_s), 6) FROM dom GROUP BY 2 UNION ALL SELECT 'split', split, count(*), round(avg(duration_s), 6) FROM dom GROUP BY 2")
def a7(spark, d):
    return profile.breakdown(domains(spark, d), ["lang", "domain_cluster", "split"], [F.count("*").alias("n"), F.round(F.avg("duration_s"), 6).alias("mean_s")])


@query("a8_shares", WD + "SELECT split, domain_cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM dom GROUP BY 1, 2")
def a8(spark, d):
    return profile.shares(domains(spark, d), "split", "domain_cluster").withColumn("share", F.round("share", 8))


@query("a9_post_stratified", WF + "SELECT round(sum(m * share), 6) AS estimate FROM (SELECT lang, avg(silence_ratio_40db) AS m FROM files WHERE split = 'train' GROUP BY 1) JOIN (SELECT lang, count(*) / sum(count(*)) OVER () AS share FROM files WHERE split = 'test' GROUP BY 1) USING (lang)")
def a9(spark, d):
    f = files(spark, d)
    return profile.post_stratified(f.where("split = 'train'"), f.where("split = 'test'"), "lang", "silence_ratio_40db").select(r6("estimate"))


@query("a10_pivot", "SELECT event_type, round(sum(value) FILTER (user_id % 3 = 0), 4) AS p0, round(sum(value) FILTER (user_id % 3 = 1), 4) AS p1, round(sum(value) FILTER (user_id % 3 = 2), 4) AS p2 FROM events GROUP BY 1")
def a10(spark, d):
    e = read(spark, d, "events").withColumn("p", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")))
    return e.groupBy("event_type").pivot("p", ["p0", "p1", "p2"]).agg(F.round(F.sum("value"), 4))


@query("a14_distinct_counts", "SELECT count(DISTINCT nullif(trim(source), '')) AS sources, count(DISTINCT nullif(trim(lang), '')) AS langs FROM documents")
def a14(spark, d):
    return read(spark, d, "documents").agg(F.countDistinct(c.present(F.col("source"))).alias("sources"), F.countDistinct(c.present(F.col("lang"))).alias("langs"))


@query("a15_missing_aware", "SELECT coalesce(nullif(trim(CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 9 = 1 THEN NULL ELSE lang END), ''), '(missing)') AS value, count(*) AS n FROM documents GROUP BY 1")
def a15(spark, d):
    return profile.missing_aware(read(spark, d, "documents").selectExpr("CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 9 = 1 THEN NULL ELSE lang END AS lang"), "lang")


@query("a18_families", "SELECT split_part(p_type, ' ', 1) AS family, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1")
def a18(spark, d):
    return read(spark, d, "part").groupBy(F.split("p_type", " ")[0].alias("family")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("a20_latency", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY 1")
def a20(spark, d):
    return profile.latency_histogram(read(spark, d, "events"), ["event_type"], "value", [10, 50, 100]).withColumn("total", F.round("total", 4))


@query("a21_reference_deltas", WF + "SELECT a.split, round(a.m, 6) AS mean_s, round(abs(a.m - b.m), 6) AS delta FROM (SELECT split, avg(duration_s) m FROM files GROUP BY 1) a, (SELECT avg(duration_s) m FROM files WHERE split = 'test') b")
def a21(spark, d):
    f = files(spark, d)
    ref = f.where("split = 'test'").agg(F.avg("duration_s").alias("b"))
    return f.groupBy("split").agg(F.avg("duration_s").alias("a")).join(F.broadcast(ref)).select("split", r6("a", "mean_s"), F.round(F.abs(F.col("a") - F.col("b")), 6).alias("delta"))


@query("a22_nearest_rank", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE pos = round_even((n - 1) * 0.9, 0)")
def a22(spark, d):
    return profile.nearest_rank(read(spark, d, "events"), "value", 0.9, "event_type").select("event_type", "value")


@query("a23_any_flag", "SELECT lang, bool_or(starts_with(source, 'src1')) AS external FROM documents GROUP BY 1")
def a23(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.bool_or(F.startswith("source", F.lit("src1"))).alias("external"))


# --- windows

@query("w1_row_index", "SELECT url, row_number() OVER (ORDER BY url, page_id) - 1 AS at FROM pages")
def w1(spark, d):
    return profile.numbered(read(spark, d, "pages").select("url", "page_id"), [F.asc("url"), F.asc("page_id")], "at").select("url", (F.col("at") - 1).alias("at"))


@query("w2_coverage", WF + ", s AS (SELECT speaker_id, sum(duration_s) AS t FROM files GROUP BY 1) SELECT row_number() OVER (ORDER BY t DESC, speaker_id) AS rank, speaker_id, round(t, 6) AS t, round(sum(t) OVER (ORDER BY t DESC, speaker_id ROWS UNBOUNDED PRECEDING) / sum(t) OVER (), 8) AS cumulative_fraction FROM s")
def w2(spark, d):
    s = files(spark, d).groupBy("speaker_id").agg(F.sum("duration_s").alias("t"))
    return profile.coverage(s, "speaker_id", "t").select(F.col("rank").cast("long").alias("rank"), "speaker_id", r6("t"), F.round("cumulative_fraction", 8).alias("cumulative_fraction"))


@query("w3_head_of_group", WD + "SELECT split, domain_cluster, row_index FROM (SELECT *, row_number() OVER (PARTITION BY split, domain_cluster ORDER BY row_index) AS r FROM dom) WHERE r <= 5")
def w3(spark, d):
    return profile.head_of(domains(spark, d), ["split", "domain_cluster"], [F.asc("row_index")], 5).select("split", "domain_cluster", "row_index")


@query("w4_ranked_cap", WF + "SELECT speaker_id, row_index FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY duration_s DESC NULLS LAST, rms_dbfs DESC NULLS LAST, silence_ratio_40db, row_index) AS r FROM files) WHERE r <= 3")
def w4(spark, d):
    return profile.head_of(files(spark, d), ["speaker_id"], [F.desc_nulls_last("duration_s"), F.desc_nulls_last("rms_dbfs"), F.asc("silence_ratio_40db"), F.asc("row_index")], 3).select("speaker_id", "row_index")


@query("w7_percentile_score", "SELECT c_custkey, round((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) / (count(*) OVER () - 1), 8) AS p FROM customer")
def w7(spark, d):
    c = profile.numbered(read(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.asc("c_acctbal"), F.asc("c_custkey")], "at")
    return c.join(F.broadcast(c.agg(F.count("*").alias("n")))).select("c_custkey", F.round((F.col("at") - 1) / (F.col("n") - 1), 8).alias("p"))


@query("w13_sliding_stats", "SELECT event_id, round(avg(value) OVER w, 6) AS m, round(greatest(var_pop(value) OVER w, 1e-10), 7) AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def w13(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return read(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("m"), F.round(F.greatest(F.var_pop("value").over(w), F.lit(1e-10)), 7).alias("v"))


@query("w14_edge_runs", "WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value < 20 AS quiet FROM events) SELECT user_id, coalesce(min(pos) FILTER (NOT quiet), count(*)) AS leading FROM x GROUP BY 1")
def w14(spark, d):
    x = read(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("at"), (F.col("value") < 20).alias("quiet"))
    return x.groupBy("user_id").agg(F.coalesce(F.min(F.when(~F.col("quiet"), F.col("at"))), F.count("*")).alias("leading"))


@query("w16_label_index", "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS label FROM documents")
def w16(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    names = profile.numbered(docs.select("source").distinct(), [F.asc("source")], "n")
    return docs.join(names, "source").select("doc_id", (F.col("n") - 1).alias("label"))


# --- sort, limit, sets

@query("t1_sort", "SELECT row_number() OVER (ORDER BY c_acctbal DESC NULLS FIRST, c_custkey) AS place, c_custkey FROM customer QUALIFY place <= 50")
def t1(spark, d):
    top = read(spark, d, "customer").orderBy(F.desc_nulls_first("c_acctbal"), "c_custkey").limit(50)
    return top.select(F.row_number().over(Window.orderBy(F.desc_nulls_first("c_acctbal"), "c_custkey")).cast("long").alias("place"), "c_custkey")


@query("t1_sort_all", "SELECT row_number() OVER (ORDER BY c_acctbal DESC NULLS FIRST, c_custkey) AS place, c_custkey FROM customer")
def t1_all(spark, d):
    c = read(spark, d, "customer").select("c_acctbal", "c_custkey")
    return profile.numbered(c, [F.desc_nulls_first("c_acctbal"), F.asc("c_custkey")], "place").select("place", "c_custkey")


@query("t2_longest", WF + "SELECT filepath, duration_s FROM files WHERE duration_s IS NOT NULL ORDER BY duration_s DESC, row_index LIMIT 200")
def t2(spark, d):
    return files(spark, d).where("duration_s is not null").orderBy(F.desc("duration_s"), "row_index").limit(200).select("filepath", "duration_s")


RULES = [("short_duration", "duration_s", False), ("long_duration", "duration_s", True), ("high_silence", "silence_ratio_40db", True), ("high_clipping", "clipping_frac", True), ("low_volume", "rms_dbfs", False), ("narrowband_proxy", "narrowband_proxy", True)]
T7 = " UNION ALL ".join(f"SELECT * FROM (SELECT filepath, '{n}' AS outlier_rule, {m} AS value FROM files WHERE {m} IS NOT NULL ORDER BY {m} {'DESC' if x else 'ASC'}, filepath LIMIT 50)" for n, m, x in RULES)


@query("t7_outliers", WF + T7)
def t7(spark, d):
    return profile.outliers(files(spark, d), RULES)


@query("t8_audit_queue", WD + f", o AS ({T7}), a AS (SELECT filepath, row_index, 'domain_stratified' AS audit_reason, 0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY split, domain_cluster ORDER BY row_index) AS r FROM dom) WHERE r <= 5 UNION ALL SELECT DISTINCT filepath, row_index, 'outlier', 1 FROM o JOIN files USING (filepath)) SELECT filepath, audit_reason FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY p) AS r FROM a) WHERE r = 1 ORDER BY p, row_index LIMIT 300")
def t8(spark, d):
    return profile.audit_queue(domains(spark, d), RULES)


@query("u2_union_diagonal", "SELECT doc_id AS id, lang, NULL::BIGINT AS turn FROM documents UNION ALL SELECT conv_id, NULL, turn FROM conversations")
def u2(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang").unionByName(read(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn"), allowMissingColumns=True)


@query("u3_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def u3(spark, d):
    return profile.head_of(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("u6_jaccard", "WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'A') SELECT round((SELECT count(*) FROM (SELECT p FROM a INTERSECT SELECT p FROM b)) / greatest(1, (SELECT count(*) FROM (SELECT p FROM a UNION SELECT p FROM b))), 8) AS jaccard")
def u6(spark, d):
    x = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    both, either = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return x.agg(F.round(F.when(either > 0, both / either).otherwise(1.0), 8).alias("jaccard"))
