"""Queries that write and read back through sources and sinks, over audio signals, and as streams; SQL over the same tables."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.operators import filterbank, signal
from tessera.operators.filterbank import FilterBank
from tessera.plans.base import FILES, KNN, files, knn, nodes, query, r6, read
from tessera.plans.evaluation import CURVE, TRIALS, curve, trials
from tessera.sources import arrays, readers, schema, sinks
from tessera.sources.lineage import fresh_path
from tessera.streaming import frontend, jobs

WF = f"WITH {FILES} "


def csv_of(df, spark) -> str:
    path = fresh_path(spark, ".csv")
    df.coalesce(1).write.csv(path, header=True)
    return path


@query("s1_train_manifest", WF + "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, filepath, speaker_id, 'train' AS split, '/data/' || filepath AS resolved_path FROM files")
def s1(spark, d):
    return readers.retrieval_manifest(spark, csv_of(files(spark, d).orderBy("row_index").select("filepath", "speaker_id"), spark), "train", "/data/")


@query("s2_test_manifest", WF + "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, filepath, NULL::VARCHAR AS speaker_id, 'test' AS split, '/data/' || filepath AS resolved_path FROM files WHERE split = 'test'")
def s2(spark, d):
    return readers.retrieval_manifest(spark, csv_of(files(spark, d).where("split = 'test'").orderBy("row_index").select("filepath"), spark), "test", "/data", labelled=False)


@query("s4_manifest_audio", "SELECT doc_id, 2 AS channels, least(100 + doc_id % 50, 30) AS frames FROM documents WHERE doc_id % 10 <> 0")
def s4(spark, d):
    """A JSON lines manifest, each row with a window of its audio."""
    path = fresh_path(spark, ".jsonl")
    wavs(spark, d).select("path", "doc_id").write.json(path)
    audio = readers.wav_windows(wavs(spark, d), 0, 30)
    return readers.json_lines(spark, path, "path string, doc_id long").join(audio, "path").where("samples is not null").select("doc_id", "channels", F.size(F.element_at("samples", 1)).cast("long").alias("frames"))


@query("s5_lenient_jsonl", "SELECT doc_id % 50 = 0 AS bad, count(*) AS lines FROM documents GROUP BY 1")
def s5(spark, d):
    path = fresh_path(spark, ".jsonl")
    read(spark, d, "documents").select(F.when(F.col("doc_id") % 50 == 0, "{broken").otherwise(F.to_json(F.struct("doc_id", "lang"))).alias("value")).write.text(path)
    return readers.json_lines(spark, path, "doc_id long, lang string", strict=False).groupBy(F.col("_corrupt_record").isNotNull().alias("bad")).agg(F.count("*").alias("lines"))


@query("s6_strict_jsonl", f"WITH {TRIALS} SELECT id, score, label FROM t")
def s6(spark, d):
    path = fresh_path(spark, ".jsonl")
    trials(spark, d).write.json(path)
    return readers.json_lines(spark, path, "id long, score double, label int")


@query("s7_table_by_suffix", "SELECT s_suppkey, s_name FROM supplier")
def s7(spark, d):
    path = fresh_path(spark, ".jsonl")
    read(spark, d, "supplier").write.json(path)
    return readers.table(spark, path, ["s_suppkey", "s_name"])


@query("s9_alignment", "SELECT c_custkey, c_name, n FROM customer JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)")
def s9(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return schema.one_to_one(read(spark, d, "customer").select("c_custkey", "c_name"), n, "c_custkey")


@query("s10_optional_table", "SELECT 'missing_source' AS status, 'nothing' AS source UNION ALL SELECT 'rows:' || count(*), 'nation' FROM nation")
def s10(spark, d):
    out = None
    for name in ("nation", "nothing"):
        found = readers.optional_table(spark, f"{d}/{name}.parquet")
        row = sinks.status_row(spark, name) if found is None else found.agg(F.concat(F.lit("rows:"), F.count("*").cast("string")).alias("status")).withColumn("source", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("s11_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def s11(spark, d):
    return readers.table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("s12_csv_columns", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def s12(spark, d):
    return readers.table(spark, csv_of(read(spark, d, "customer"), spark), ["c_custkey", "c_mktsegment"])


@query("s13_best_row", "SELECT doc_id % 97 AS k, doc_id, error FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'io' END AS error FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY error IS NOT NULL, doc_id) = 1")
def s13(spark, d):
    x = read(spark, d, "documents").select((F.col("doc_id") % 97).alias("k"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "io").alias("error"))
    return readers.best_row(x, "k", [F.col("error").isNotNull(), F.col("doc_id")])


@query("s14_directory", "SELECT 'speaker=' || source AS speaker_id, count(DISTINCT source) AS files FROM documents WHERE source IS NOT NULL GROUP BY 1")
def s14(spark, d):
    path = fresh_path(spark)
    read(spark, d, "documents").where("source is not null").select(F.col("source").alias("speaker"), F.col("doc_id").cast("string").alias("value")).repartition(1).write.partitionBy("speaker").text(path)
    return readers.directory_manifest(spark, path, "*.txt", exclude=("noise",)).groupBy("speaker_id").agg(F.count("*").alias("files"))


@query("s15_submission", f"WITH {KNN(5)} SELECT row_number() OVER (ORDER BY src) - 1 AS row_index, 'f' || src AS filepath, string_agg(dst::VARCHAR, ';' ORDER BY rank) AS neighbours FROM knn GROUP BY src")
def s15(spark, d):
    manifest = nodes(spark, d).select(F.col("id").alias("row_index"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("filepath"))
    path = fresh_path(spark, ".csv")
    sinks.write_submission(sinks.submission_rows(knn(spark, d, 5), manifest, 5), path)
    return readers.submission(spark, path).select("row_index", "filepath", F.concat_ws(";", F.transform("neighbours", lambda x: x.cast("string"))).alias("neighbours"))


@F.pandas_udf(BinaryType())
def wav_bytes(seed: pd.Series) -> pd.Series:
    """A made-up stereo file of 100 and more frames; every tenth is no audio file."""

    def one(i: int) -> bytes:
        if i % 10 == 0:
            return b"no audio"
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(16_000)
            n = np.arange(100 + i % 50)
            w.writeframes(np.stack([n * 7 % 1000, n * 3 % 1000], axis=1).astype("<i2").tobytes())
        return out.getvalue()

    return seed.map(one)


def wavs(spark, d):
    return read(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id", wav_bytes("doc_id").alias("content"))


@query("s16_wav_headers", "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 10 <> 0 THEN 100 + doc_id % 50 END AS frames, CASE WHEN doc_id % 10 <> 0 THEN 16000 END AS rate, CASE WHEN doc_id % 10 <> 0 THEN 2 END AS channels, CASE WHEN doc_id % 10 <> 0 THEN round((100 + doc_id % 50) / 16000e0, 6) END AS seconds, doc_id % 10 = 0 AS failed FROM documents")
def s16(spark, d):
    return readers.wav_headers(wavs(spark, d)).select("path", "frames", "rate", "channels", r6("seconds"), F.col("error").isNotNull().alias("failed"))


@query("s17_audio_window", "SELECT 'f' || doc_id AS path, 2 AS channels, round(list_sum([(i * 7 % 1000) / 32768e0 FOR i IN range(20, least(60, 100 + doc_id % 50))]), 6) AS first, round(list_sum([(i * 3 % 1000) / 32768e0 FOR i IN range(20, least(60, 100 + doc_id % 50))]), 6) AS second FROM documents WHERE doc_id % 10 <> 0")
def s17(spark, d):
    total = lambda i: F.round(F.aggregate(F.element_at("samples", i), F.lit(0.0), lambda a, x: a + x), 6)
    return readers.wav_windows(wavs(spark, d), 20, 40).where("samples is not null").select("path", "channels", total(1).alias("first"), total(2).alias("second"))


@query("s19_enrolment_scan", "SELECT row_number() OVER (ORDER BY user_id) AS place, user_id, event_id FROM (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1)")
def s19(spark, d):
    from tessera.operators.profile import numbered

    path = fresh_path(spark, ".parquet")
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    sinks.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").write.parquet(path)
    return numbered(readers.table(spark, path, ["user_id", "event_id"]), [F.asc("user_id")], "place").select("place", "user_id", "event_id")


@query("s21_trial_list", f"WITH {TRIALS} SELECT label, (id // 10)::VARCHAR AS left_id, (id // 10 + id % 10)::VARCHAR AS right_id FROM t")
def s21(spark, d):
    path = fresh_path(spark, ".txt")
    left = F.floor(F.col("id") / 10)
    trials(spark, d).select(F.concat_ws("  ", "label", left.cast("string"), (left + F.col("id") % 10).cast("string")).alias("value")).write.text(path)
    return readers.trial_list(spark, path)


@query("k3_artifact", WF + "SELECT count(*) AS rows, count(DISTINCT nullif(trim(speaker_id), '')) AS speakers, count(DISTINCT nullif(trim(filepath), '')) AS audio, round(coalesce(sum(duration_s), 0), 4) AS seconds FROM files")
def k3(spark, d):
    counts = sinks.write_artifact(files(spark, d), fresh_path(spark), ("row_index",), audio="filepath", seconds="duration_s")
    return spark.createDataFrame([(counts["rows"], counts["speakers"], counts["audio"], round(counts["seconds"], 4))], "rows long, speakers long, audio long, seconds double")


@query("k4_inventory", "SELECT 'nation' AS name, count(*) AS rows, 3 AS columns FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region UNION ALL SELECT 'supplier', count(*), 4 FROM supplier")
def k4(spark, d):
    return sinks.inventory({n: read(spark, d, n) for n in ("nation", "region", "supplier")})


@query("k5_flat", "SELECT o_custkey, '[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY 1")
def k5(spark, d):
    return sinks.flat(read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders")))


@query("k7_artifact_index", "SELECT 'nation' AS file, true AS exists, true AS filled UNION ALL SELECT 'nothing', false, false")
def k7(spark, d):
    return sinks.artifact_index(spark, {n: f"{d}/{n}.parquet" for n in ("nation", "nothing")}).select("file", "exists", (F.coalesce("bytes", F.lit(0)) > 0).alias("filled"))


@query("k8_parquet", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def k8(spark, d):
    path = fresh_path(spark, ".parquet")
    read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return readers.table(spark, path).where("c_mktsegment = 'BUILDING'")


@query("k9_npy_sink", "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def k9(spark, d):
    """Embeddings as a matrix of .npy files in order of their ids, with their metadata beside it, read back by row."""
    path = fresh_path(spark)
    arrays.write_bank(read(spark, d, "embeddings"), path, "vec_id", "embedding")
    return arrays.read_bank(spark, path).select("vec_id", "row", F.size("values").cast("long").alias("width"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s8_embedding_matrix", "SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS first, round(sum(embedding[64]::DOUBLE), 4) AS last FROM embeddings GROUP BY 1")
def s8(spark, d):
    """A matrix read by parts of 100 rows, joined to its metadata by row."""
    path = fresh_path(spark)
    arrays.write_bank(read(spark, d, "embeddings"), path, "vec_id", "embedding")
    rows = spark.read.format("npy").option("rows", 100).load(f"{path}/matrix")
    return spark.read.parquet(f"{path}/rows.parquet").join(rows, "row").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("values", 1).cast("double")), 4).alias("first"), F.round(F.sum(F.element_at("values", 64).cast("double")), 4).alias("last"))


@query("s18_feature_pack", "WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), n AS (SELECT user_id, count(*) // 4 AS frames FROM f GROUP BY 1), o AS (SELECT user_id, frames, coalesce(sum(frames) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n) SELECT o.user_id, first, frames, round(coalesce(sum(value::FLOAT::DOUBLE) FILTER (i < frames * 4), 0), 3) AS total FROM o JOIN f ON f.user_id = o.user_id GROUP BY 1, 2, 3")
def s18(spark, d):
    """Frames of four event values for each user, packed into one matrix and read back by each user's byte range."""
    path = fresh_path(spark)
    whole = event_values(spark, d).withColumn("frames", F.transform(F.sequence(F.lit(0), F.floor(F.size("values") / 4).cast("int")), lambda i: F.slice("values", 4 * i + 1, 4)))
    arrays.write_pack(whole.select("user_id", F.filter("frames", lambda f: F.size(f) == 4).alias("frames")), path, "user_id", "frames")
    got = arrays.read_pack(spark, path, key="user_id").join(spark.read.parquet(f"{path}/places.parquet"), "user_id")
    return got.select("user_id", "first", F.col("count").alias("frames"), F.round(F.aggregate(F.flatten("frames"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def event_values(spark, d):
    """(user_id, values): each user's event values in order."""
    return read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("values"))


@query("k10_mixed_manifest", "SELECT doc_id, lang, NULL::INT AS toxic, 0 AS part FROM documents UNION ALL SELECT doc_id, NULL, toxic, 1 FROM labels")
def k10(spark, d):
    return sinks.mixed_manifest(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select("doc_id", "toxic"))


@query("k14_long", f"WITH {KNN(5)} SELECT src AS query, rank, dst AS neighbor, round(score, 6) AS similarity FROM knn")
def k14(spark, d):
    return sinks.long_rows(knn(spark, d, 5), 5).select("query", F.col("rank").cast("long").alias("rank"), "neighbor", r6("similarity"))


@query("k15_curve_lines", f"WITH {CURVE} SELECT threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM curve")
def k15(spark, d):
    path = fresh_path(spark, ".jsonl")
    curve(spark, d).select("threshold", r6("far"), r6("frr")).write.json(path)
    return readers.json_lines(spark, path, "threshold double, far double, frr double")


# --- signals: samples made of the documents' numbers

SIG = "g AS (SELECT doc_id, [greatest(-1e0, least(1e0, round(sin(i * (doc_id % 7 + 1) / 9e0) * ((doc_id % 5 + 1) / 4e0), 6))) FOR i IN range(0, 200 + doc_id % 100)] AS x FROM documents)"


def signals(spark, d):
    n, i = F.col("doc_id"), F.sequence(F.lit(0).cast("long"), 199 + F.col("doc_id") % 100)
    x = F.transform(i, lambda i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(F.sin(i * (n % 7 + 1) / F.lit(9.0)) * ((n % 5 + 1) / F.lit(4.0)), 6))))
    return read(spark, d, "documents").select("doc_id", x.alias("x"))


def summed(x):
    return F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 3)


LEVEL = "20 * log10(greatest(sqrt(list_dot_product(x, x) / len(x)), 1e-8)) AS rms, 20 * log10(greatest(list_max([abs(v) FOR v IN x]), 1e-8)) AS peak"


@query("q1_profile", f"WITH {SIG} SELECT doc_id, round(20 * log10(greatest(sqrt(list_dot_product(x, x) / len(x)), 1e-8)), 6) AS rms_dbfs, round(20 * log10(greatest(list_max([abs(v) FOR v IN x]), 1e-8)), 6) AS peak_dbfs, len([i FOR i IN range(2, len(x) + 1) IF x[i - 1] * x[i] < 0]) AS zero_crossings, round(len([v FOR v IN x IF abs(v) >= 0.999]) / len(x), 6) AS clipping_frac FROM g")
def q1(spark, d):
    level = signal.loudness(F.col("x"))
    return signals(spark, d).select("doc_id", *[(F.round(v, 6) if k != "zero_crossings" else v.cast("long")).alias(k) for k, v in level.items()])


@query("q3_crops", f"WITH {SIG}, c AS (SELECT doc_id, x, k, floor(k * (len(x) - 150) / 2)::BIGINT AS a FROM g, (SELECT unnest(range(0, 3)) AS k)) SELECT doc_id, k AS crop, round(list_sum(x[a + 1:a + 150]), 3) AS total FROM c")
def q3(spark, d):
    e = signals(spark, d).select("doc_id", F.posexplode(signal.crops(F.col("x"), 150, 3)).alias("crop", "c"))
    return e.select("doc_id", F.col("crop").cast("long").alias("crop"), summed(F.col("c")).alias("total"))


@query("q3_tiled_crop", f"WITH {SIG} SELECT doc_id, round(list_sum(list_concat(list_concat(x, x), x)[1:400]), 3) AS total FROM g")
def q3_tiled(spark, d):
    return signals(spark, d).select("doc_id", summed(F.element_at(signal.crops(F.col("x"), 400, 1), 1)).alias("total"))


@query("q5_vad_guards", f"WITH {SIG}, k AS (SELECT doc_id, len(x) AS n, len([v FOR v IN x IF abs(v) >= 0.5]) AS kept FROM g) SELECT doc_id, CASE WHEN kept <= 0 THEN 'no_speech' WHEN kept < 60 THEN 'too_short' WHEN kept < 0.4 * n THEN 'too_much_removed' WHEN kept >= n THEN 'unchanged' ELSE 'trimmed' END AS decision FROM k")
def q5(spark, d):
    kept = F.size(F.filter("x", lambda v: F.abs(v) >= 0.5))
    return signals(spark, d).select("doc_id", signal.guarded(F.size("x"), kept, F.lit(60), 0.4).alias("decision"))


@query("q6_bounded_gain", f"WITH {SIG}, l AS (SELECT doc_id, {LEVEL} FROM g) SELECT doc_id, round(least(greatest(-20 - rms, -12), 12, -1 - peak), 6) AS gain FROM l")
def q6(spark, d):
    level = signal.loudness(F.col("x"))
    return signals(spark, d).select("doc_id", F.round(signal.bounded_gain(level["rms_dbfs"], level["peak_dbfs"], -20.0, 12.0), 6).alias("gain"))


CONV = "[coalesce(x[i], 0) * 0.25 + coalesce(x[i - 1], 0) * 0.5 * (i > 1)::INT + coalesce(x[i - 2], 0) * 0.25 * (i > 2)::INT FOR i IN range(1, len(x) + 3)]"


@query("q7_convolved", f"WITH {SIG}, y AS (SELECT doc_id, {CONV} AS y FROM g) SELECT doc_id, len(y) AS n, round(y[20], 8) AS twentieth, round(y[10], 8) AS tenth FROM y")
def q7(spark, d):
    y = signals(spark, d).select("doc_id", signal.convolved("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))).alias("y"))
    return y.select("doc_id", F.size("y").cast("long").alias("n"), F.round(F.element_at("y", 20), 8).alias("twentieth"), F.round(F.element_at("y", 10), 8).alias("tenth"))


def bank_sql(bank: FilterBank, samples: str) -> str:
    """CTEs up to e(utt, frame, band, v): the log energies of samples(utt, i, value), by sums over the samples of each frame and frequency."""
    taper = ", ".join(f"({j}, {float(w)!r}::DOUBLE)" for j, w in enumerate(bank.taper()))
    weight = ", ".join(f"({k}, {b}, {float(w)!r}::DOUBLE)" for (k, b), w in np.ndenumerate(bank.weights()) if w > 0)
    frames = f"CASE WHEN n <= {bank.size} THEN 1 ELSE (n - {bank.size} + {bank.hop - 1}) // {bank.hop} + 1 END"
    return f"""{samples}, size AS (SELECT utt, count(*) AS n FROM samples GROUP BY 1), fr AS (SELECT utt, unnest(range(0, {frames})) AS frame FROM size),
        taper(j, t) AS (VALUES {taper}), band(k, band, w) AS (VALUES {weight}), freq AS (SELECT unnest(range(0, {bank.fft // 2 + 1})) AS k),
        turn AS (SELECT j, k, t * cos(2 * pi() * k * j / {bank.fft}) AS c, t * sin(2 * pi() * k * j / {bank.fft}) AS s FROM taper, freq),
        sums AS (SELECT fr.utt, frame, k, sum(value * c) AS re, sum(value * s) AS im FROM fr JOIN samples x ON x.utt = fr.utt AND i >= frame * {bank.hop} AND i < frame * {bank.hop} + {bank.size} JOIN turn ON j = i - frame * {bank.hop} GROUP BY 1, 2, 3),
        e AS (SELECT utt, frame, band, ln(greatest(sum((re * re + im * im) * w), {bank.floor})) AS v FROM sums JOIN band USING (k) GROUP BY 1, 2, 3)"""


DOCUMENT_BANK = FilterBank(rate=1000, bands=4, frame_ms=24, hop_ms=12, fft=32)


@query("q8_log_mel", f"WITH {SIG}, {bank_sql(DOCUMENT_BANK, 'samples AS (SELECT doc_id AS utt, unnest(x) AS value, unnest(range(0, len(x))) AS i FROM g)')} SELECT utt AS doc_id, count(DISTINCT frame) AS frames, count(DISTINCT band) AS bands, round(avg(v), 4) AS mean FROM e GROUP BY 1")
def q8(spark, d):
    """Frames and bands of the log filterbank, and its mean."""
    m = signals(spark, d).select("doc_id", filterbank.log_mel(DOCUMENT_BANK)("x").alias("m"))
    return m.select("doc_id", F.size("m").cast("long").alias("frames"), F.size(F.element_at("m", 1)).cast("long").alias("bands"), F.round(F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, v: a + v) / F.size(F.flatten("m")), 4).alias("mean"))


@query("q9_mean_normalised", f"WITH {SIG}, f AS (SELECT doc_id, i, x[2 * i + 1] AS a, x[2 * i + 2] AS b FROM g, (SELECT unnest(range(0, 100)) AS i)) SELECT doc_id, count(*) AS frames, round(max(a - m), 6) AS most_a, round(min(b - n), 6) AS least_b FROM (SELECT *, avg(a) OVER (PARTITION BY doc_id) AS m, avg(b) OVER (PARTITION BY doc_id) AS n FROM f) GROUP BY 1")
def q9(spark, d):
    frames = signal.once(F.col("x"), lambda x: F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.slice(x, 2 * i + 1, 2)))
    f = signals(spark, d).select("doc_id", signal.mean_normalised(frames).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("frames"), F.round(F.array_max(F.transform("f", lambda v: v[0])), 6).alias("most_a"), F.round(F.array_min(F.transform("f", lambda v: v[1])), 6).alias("least_b"))


@query("q10_distortions", f"WITH {SIG} SELECT doc_id, round(list_sum([greatest(-0.5, least(0.5, v)) FOR v IN x]), 3) AS clipped, round(list_sum([CASE WHEN (doc_id * 31 + (i - 1) // 20 * 17) % 5 = 0 THEN 0 ELSE x[i] END FOR i IN range(1, len(x) + 1)]), 3) AS dropped, round(list_sum([floor(v * 16 + 0.5) / 16 FOR v IN x]), 3) AS quantised, round(list_sum([x[i] + 0.1 * (((doc_id * 7919 + (i - 1) * 104729 + 13) % 1000) / 500e0 - 1) FOR i IN range(1, len(x) + 1)]), 3) AS noisy FROM g")
def q10(spark, d):
    x, n = F.col("x"), F.col("doc_id")
    return signals(spark, d).select("doc_id", summed(signal.clipped(x, 0.5)).alias("clipped"), summed(signal.dropped_packets(x, 20, n, 5)).alias("dropped"), summed(signal.quantised(x, 16)).alias("quantised"), summed(signal.noisy(x, n, 0.1)).alias("noisy"))


@query("q11_channel_shift", f"WITH {SIG}, y AS (SELECT doc_id, [0.8 * v FOR v IN {CONV}] AS y FROM g) SELECT doc_id, round(sqrt(list_dot_product(y, y)), 5) AS energy FROM y")
def q11(spark, d):
    y = signals(spark, d).select("doc_id", signal.convolved("x", F.array(F.lit(0.2), F.lit(0.4), F.lit(0.2))).alias("y"))
    return y.select("doc_id", F.round(F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v)), 5).alias("energy"))


@query("q13_loaded", f"WITH {SIG}, m AS (SELECT doc_id, [(v + v * 0.5) / 2 FOR v IN x[11:160]] AS x FROM g), l AS (SELECT doc_id, x, {LEVEL} FROM m) SELECT doc_id, len(x) AS n, round(list_sum(x) * power(10, least(greatest(-20 - rms, -12), 12, -1 - peak) / 20), 3) AS total FROM l")
def q13(spark, d):
    y = signals(spark, d).select("doc_id", signal.loaded(F.array("x", F.transform("x", lambda v: v * 0.5)), 10, 150, -20.0, 12.0).alias("y"))
    return y.select("doc_id", F.size("y").cast("long").alias("n"), summed(F.col("y")).alias("total"))


# --- streams


def arriving(spark, d) -> str:
    """Events in a folder of three files, one after the other in order of their ids."""
    path, e = fresh_path(spark), read(spark, d, "events")
    most = e.agg(F.max("event_id")).first()[0] or 0
    for i in range(3):
        e.where(F.floor(F.col("event_id") * 3 / F.lit(most + 1)) == i).coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(path)
    return path


EVENT_BANK = FilterBank(rate=1000, bands=4, frame_ms=16, hop_ms=6, fft=16)
EVENT_SAMPLES = "samples AS (SELECT user_id AS utt, value / 100 AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"


def event_chunks(spark, d, size: int = 7):
    """Each user's event values as a signal in chunks of `size` samples, the last one marked."""
    w = Window.partitionBy("user_id")
    e = read(spark, d, "events").withColumns({"i": F.row_number().over(w.orderBy("event_id")) - 1, "n": F.count("*").over(w)})
    chunks = e.groupBy("user_id", F.floor(F.col("i") / size).alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("value") / 100).alias("v")))), lambda x: x["v"]).alias("samples"), (F.max("i") + 1 == F.first("n")).alias("last"))
    return chunks.select(F.col("user_id").cast("string").alias("utt"), "seq", "samples", "last", F.when(F.col("user_id") % 2 == 0, 8.0).otherwise(16.0).alias("extra"))


def shuffled_chunks(spark, d) -> str:
    """The chunks in a folder of three files that each hold some chunks of every signal, in no order."""
    path = fresh_path(spark)
    event_chunks(spark, d).repartition(3, F.xxhash64("utt", "seq")).write.parquet(path)
    return path


def long_frames(df):
    return df.select(F.col("utt").cast("long").alias("utt"), "frame", F.posexplode("values").alias("band", "v")).select("utt", "frame", F.col("band").cast("long").alias("band"), F.round("v", 5).alias("v"))


@query("q8_filterbank", f"WITH {bank_sql(EVENT_BANK, EVENT_SAMPLES)} SELECT utt, frame, band, round(v, 5) AS v FROM e")
def q8_bank(spark, d):
    """The filterbank over each user's whole signal of event values."""
    x = event_chunks(spark, d, 1 << 30).select("utt", filterbank.log_mel(EVENT_BANK)("samples").alias("m"))
    return long_frames(x.select("utt", F.posexplode("m").alias("frame", "values")).withColumn("frame", F.col("frame").cast("long")))


NORMALISED = "SELECT utt, frame, band, round((v - avg(v) OVER w) / sqrt(greatest(var_pop(v) OVER w, 1e-5)), 5) AS v FROM e WINDOW w AS (PARTITION BY utt, band ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("st1_online_filterbank", f"WITH {bank_sql(EVENT_BANK, EVENT_SAMPLES)} {NORMALISED}")
def st1_bank(spark, d):
    """The same filterbank, normalised over five frames, from a stream of chunks in any order."""
    return long_frames(jobs.replay(spark, shuffled_chunks(spark, d), lambda c: frontend.online_bank(c.drop("extra"), EVENT_BANK, 5), "append"))


WIDTHS = {8: (6, 2), 16: (10, 3)}


@query("st2_online_activity", f"""WITH RECURSIVE {EVENT_SAMPLES}, size AS (SELECT utt, count(*) AS n, CASE WHEN utt % 2 = 0 THEN 6 ELSE 10 END AS width, CASE WHEN utt % 2 = 0 THEN 2 ELSE 3 END AS before FROM samples GROUP BY 1),
    win AS (SELECT *, unnest(range(0, (n + width - 1) // width)) AS win FROM size),
    level AS (SELECT win.utt, win, any_value(width + before) AS len, 10 * log10(greatest(sum(value * value) / any_value(width + before), 1e-10)) AS level FROM win JOIN samples x ON x.utt = win.utt AND i >= win * width - before AND i < win * width + width GROUP BY 1, 2),
    h AS (SELECT utt, win, level AS fast, level AS slow FROM level WHERE win = 0 UNION ALL SELECT l.utt, l.win, 0.5 * h.fast + 0.5 * l.level, 0.99 * h.slow + 0.01 * l.level FROM h JOIN level l ON l.utt = h.utt AND l.win = h.win + 1)
    SELECT utt, win AS "window", round(1 / (1 + exp(-0.5 * (fast - slow - 6))), 5) AS probability FROM h""")
def st2_activity(spark, d):
    """Voice activity with composite state over the stream of chunks; the rate, and so the window, differs between users."""
    p = jobs.replay(spark, shuffled_chunks(spark, d), lambda c: frontend.online_activity(c, widths=WIDTHS), "append")
    return p.select(F.col("utt").cast("long").alias("utt"), "window", F.round("probability", 5).alias("probability"))


@query("st1_sliding_normalised", "SELECT event_id AS at, round((value - avg(value) OVER w) / sqrt(greatest(var_pop(value) OVER w, 1e-10)), 4) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def st1(spark, d):
    frames = lambda e: jobs.sliding_normalised(e.select(F.col("user_id").cast("string").alias("utt"), F.col("event_id").alias("at"), F.array("value").alias("values")), 10)
    return jobs.replay(spark, arriving(spark, d), frames, "append").select("at", F.round(F.element_at("values", 1), 4).alias("z"))


@query("st2_recurrent_activity", "WITH RECURSIVE f AS (SELECT user_id, event_id, floor(value * 1000 + 0.5)::BIGINT AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), l AS (SELECT user_id, event_id, i, floor(e / 10)::BIGINT AS level FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.event_id, f.i, l.level + floor((f.e - l.level) / 10)::BIGINT FROM l JOIN f ON f.user_id = l.user_id AND f.i = l.i + 1) SELECT event_id AS at, level, level >= 20000 AS speech FROM l")
def st2(spark, d):
    frames = lambda e: jobs.recurrent_activity(e.select(F.col("user_id").cast("string").alias("utt"), F.col("event_id").alias("at"), F.col("value").alias("energy")), 10, 20_000)
    return jobs.replay(spark, arriving(spark, d), frames, "append").select("at", "level", "speech")


@query("st4_telemetry_stream", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY 1, 2")
def st4_stream(spark, d):
    return jobs.replay(spark, arriving(spark, d), lambda e: jobs.telemetry(e.withColumn("ts", F.col("ts").cast("timestamp"))))


@query("st5_upsert_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def st5(spark, d):
    """Events in four files, one micro-batch each, merged into one table of the newest row for each user."""
    source, target = fresh_path(spark), fresh_path(spark)
    read(spark, d, "events").select("user_id", "event_id", "value").repartition(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema("user_id long, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.upsert_stream(stream, target, "user_id", "event_id").option("checkpointLocation", fresh_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return jobs.latest(spark, target).select("user_id", "event_id")
