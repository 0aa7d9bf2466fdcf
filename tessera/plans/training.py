"""Queries over training batches, resampled and distorted signals, and empirical channel shift; SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audio, batches, cohort
from tessera.operators.batches import PRIME, ROUNDS
from tessera.plans.base import FILES, files, query, read
from tessera.plans.storage import SIG, signals
from tessera.sources import arrays, ledger
from tessera.sources.lineage import fresh_path


def mixed_sql(x: str) -> str:
    return f"((({x}) % {PRIME}) * (({x}) % {PRIME}) % {PRIME} * 48271 + 11) % {PRIME}"


def key_sql(*parts: str) -> str:
    text = " || ':' || ".join(f"({p})::BIGINT::VARCHAR" for p in parts)
    return f"(('0x' || substr(sha256({text}), 1, 8))::BIGINT % {PRIME})"


def shuffled_sql(x: str, n: str, key: str) -> str:
    other = f"(({mixed_sql(f'{key} + r * 7919')}) % {n} - x + {n}) % {n}"
    bit = mixed_sql(f"greatest(x, {other}) % {PRIME} * 69621 + {key} + r * 104729")
    return f"list_reduce(list_concat([({x})::BIGINT], range(0, {ROUNDS})), lambda x, r: CASE WHEN (({bit}) >> 7) % 2 = 1 THEN {other} ELSE x END)"


SIZE, OUTER, SEED = 16, 4, 7
N14 = f"""WITH ev AS (SELECT user_id AS owner, event_id AS key FROM events), o AS (SELECT owner, count(*) AS rows, max((owner % 3 = 0)::INT) AS domain FROM ev GROUP BY 1),
    w AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY owner) - 1 AS at FROM o), n AS (SELECT domain, count(*) AS n FROM o GROUP BY 1),
    r AS (SELECT owner, key, row_number() OVER (PARTITION BY owner ORDER BY key) - 1 AS place FROM ev), ids AS (SELECT unnest(range(0, {SIZE} * (SELECT (count(*) + {SIZE - 1}) // {SIZE} FROM ev))) AS id),
    s AS (SELECT id // {SIZE} AS batch, id % {SIZE} AS slot, (id % {SIZE} >= {SIZE - OUTER})::INT AS domain, CASE WHEN id % {SIZE} >= {SIZE - OUTER} THEN id // {SIZE} * {OUTER} + id % {SIZE} - {SIZE - OUTER} ELSE id // {SIZE} * {SIZE - OUTER} + id % {SIZE} END AS p FROM ids),
    k AS (SELECT s.*, n, {key_sql(str(SEED), "0", "s.domain")} AS k FROM s JOIN n ON n.domain = s.domain), d AS (SELECT *, {shuffled_sql("p % n", "n", "k")} AS at FROM k),
    v AS (SELECT d.batch, d.slot, d.domain, w.owner, w.rows, d.p // d.n AS visit, {key_sql(str(SEED), "0", "(d.domain + 2)", "d.at", "(d.p // d.n // w.rows)")} AS k FROM d JOIN w ON w.domain = d.domain AND w.at = d.at),
    y AS (SELECT *, {shuffled_sql("visit % rows", "rows", "k")} AS place FROM v)
    SELECT 0 AS epoch, batch, slot, domain, y.owner, key, round(2 + 2 * ({key_sql(str(SEED), "0", "5", "batch")}) / {PRIME}e0, 6) AS crop_seconds, {key_sql(str(SEED), "0", "batch", "slot")} AS request_seed FROM y JOIN r ON r.owner = y.owner AND r.place = y.place"""


def event_table(spark, d):
    return batches.balanced(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", F.col("user_id") % 3 == 0)


@query("n14_balanced_batches", N14)
def n14(spark, d):
    """One epoch of batches of 16 events, four of each batch from the users of the external domain."""
    out, _ = batches.taken(event_table(spark, d), SIZE, SEED, batches.Progress(), -(-read(spark, d, "events").count() // SIZE), share=OUTER / SIZE)
    return out


@query("st3_resumed_batches", N14)
def st3(spark, d):
    """The same epoch in three parts, each begun from the stored state of the one before."""
    table = event_table(spark, d)
    per_epoch, state, out = -(-table.total // SIZE), batches.Progress().state(), None
    for n in (per_epoch // 3, per_epoch // 4, per_epoch - per_epoch // 3 - per_epoch // 4):
        part, after = batches.taken(table, SIZE, SEED, batches.Progress(**state), n, share=OUTER / SIZE)
        out, state = part if out is None else out.unionByName(part), after.state()
    return out


def draw_sql(salt: int) -> str:
    return key_sql("11", str(salt), "row_index")


@query("q11_shift_plan", f"""WITH {FILES}, pub AS (SELECT * FROM files WHERE split = 'test'), n AS (SELECT count(*) AS n, avg((coalesce(narrowband_proxy, 0) >= 0.5 OR coalesce(rolloff95_hz <= 3800, false))::INT) AS narrow, avg((peak_dbfs >= -0.1)::INT) AS peak FROM pub),
    a AS (SELECT silence_ratio_40db AS v, row_number() OVER (ORDER BY silence_ratio_40db, row_index) - 1 AS at FROM pub), b AS (SELECT spectral_flatness AS v, row_number() OVER (ORDER BY spectral_flatness, row_index) - 1 AS at FROM pub),
    f AS (SELECT row_index, {draw_sql(0)} AS k0, {draw_sql(1)} AS k1, {draw_sql(2)} AS k2, {draw_sql(3)} AS k3 FROM files WHERE split <> 'test')
    SELECT row_index, a.v AS lead_s, b.v AS trail_s, k2 / {PRIME}e0 < least(narrow, 0.5) AS band_limit, k3 / {PRIME}e0 < peak AS peak_limit FROM f, n JOIN a ON a.at = k0 % n JOIN b ON b.at = k1 % n""".replace("FROM f, n JOIN a", "FROM f CROSS JOIN n JOIN a"))
def q11_plan(spark, d):
    """Silence and channel flags of the training files, drawn from the test files' own distributions."""
    f = files(spark, d)
    return audio.shift_plan(f.where("split <> 'test'"), "row_index", f.where("split = 'test'"), "row_index", 11, "silence_ratio_40db", "spectral_flatness")


def level(x: str) -> F.Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


@query("q10_noise_levels", f"WITH {SIG}, l AS (SELECT doc_id, sqrt(list_dot_product(x, x) / len(x)) AS l FROM g), c(color, snr) AS (VALUES ('white', 20), ('pink', 10), ('brown', 0)) SELECT doc_id, color, round(CASE WHEN l > 1e-8 THEN l / power(10, snr / 20e0) ELSE 0 END, 6) AS added FROM l, c")
def q10_noise(spark, d):
    """The level of what each colour of noise adds at its signal-to-noise ratio."""
    s, out = signals(spark, d), None
    for color, snr in (("white", 20.0), ("pink", 10.0), ("brown", 0.0)):
        y = s.select("doc_id", "x", audio.distorted(F.col("x"), F.col("doc_id"), 3, "additive_noise", 1000, snr_db=snr, color=color).alias("y"))
        y = y.select("doc_id", F.lit(color).alias("color"), F.zip_with("y", "x", lambda a, b: a - b).alias("z")).select("doc_id", "color", F.round(level("z"), 6).alias("added"))
        out = y if out is None else out.unionByName(y)
    return out


@query("q10_matched_levels", f"WITH {SIG}, l AS (SELECT doc_id, len(x) AS n, round(sqrt(list_dot_product(x, x) / len(x)), 6) AS level FROM g) SELECT doc_id, family, n, level FROM l, (SELECT unnest(['reverb', 'codec_light', 'codec_heavy']) AS family)")
def q10_levels(spark, d):
    """Reverberation and narrow channels keep a signal's length and level."""
    s, out = signals(spark, d), None
    for name, family, p in (("reverb", "reverb", {"rt60_s": 0.3, "direct_gain": 1.0}), ("codec_light", "codec_bandwidth", {"low_hz": 0, "high_hz": 450, "bits": 12}), ("codec_heavy", "codec_bandwidth", {"low_hz": 0, "high_hz": 300, "bits": 10, "heavy": True})):
        y = s.select("doc_id", F.lit(name).alias("family"), audio.distorted(F.col("x"), F.col("doc_id"), 3, family, 1000, **p).alias("y"))
        y = y.select("doc_id", "family", F.size("y").cast("long").alias("n"), F.round(level("y"), 6).alias("level"))
        out = y if out is None else out.unionByName(y)
    return out


@query("q13_resampled", f"WITH {SIG} SELECT doc_id, (len(x) * 5 + 3) // 4 AS n FROM g")
def q13_resampled(spark, d):
    """Samples of each signal at five fourths of its rate."""
    return signals(spark, d).select("doc_id", F.size(audio.resampled(F.col("x"), 1000, 1250)).cast("long").alias("n"))


@query("q13_loader")
def q13_loader(spark, d):
    """The whole loader: window, downmix, resampling, trimming, bounded loudness; length and level of what it hands on."""
    y = signals(spark, d).select("doc_id", audio.loaded(F.array("x", F.transform("x", lambda v: v * 0.5)), 1000, 800, 0.02, 0.25, -20.0, 12.0).alias("y"))
    return y.select("doc_id", F.size("y").cast("long").alias("n"), F.round(level("y"), 6).alias("level"))


@query("q1_full_profile")
def q1_full(spark, d):
    """The seventeen measures of each signal."""
    return signals(spark, d).select("doc_id", audio.profile(F.col("x"), 1000).alias("p")).select("doc_id", *[F.round(F.col(f"p.{n}"), 6).alias(n) for n in audio.PROFILE])


@query("q2_trimmed")
def q2_trimmed(spark, d):
    """Samples that energy trimming leaves of each signal between silences."""
    s = signals(spark, d).select("doc_id", F.concat(F.array_repeat(F.lit(0.0), 400), "x", F.array_repeat(F.lit(0.0), 300)).alias("x"))

    from tessera.operators import signal

    return s.select("doc_id", F.size(signal.trimmed(1000, least=0.1)("x")).cast("long").alias("n"))


@query("st6_resumed_conditions", "SELECT l_returnflag AS model, l_linestatus || l_linenumber AS condition, count(*) AS rows, round(avg(l_discount), 8) AS eer FROM lineitem GROUP BY 1, 2")
def st6(spark, d):
    """A measure of each model and condition from two runs over one ledger, the first of which is stopped after a part."""
    path, keys = fresh_path(spark), ["model", "condition"]
    plan = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("condition"), "l_discount")
    measure = lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.round(F.avg("l_discount"), 8).alias("eer"))
    ledger.run_pending(plan, path, keys, measure, most=1)
    ledger.run_pending(plan, path, keys, measure)
    return ledger.finished_results(spark, path, "model string, condition string, rows long, eer double", keys).select(*keys, "rows", "eer")


BANK = """WITH s AS (SELECT doc_id, source, lang, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id), f AS (SELECT * FROM s WHERE lower(lang) IN ('en', 'fr')),
    a AS (SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), c AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM a),
    l AS (SELECT * FROM c WHERE n >= 5 AND turn <= 8), b AS (SELECT *, row_number() OVER (ORDER BY turn, source, doc_id) - 1 AS place FROM l QUALIFY place < 120)"""


def cohort_parts(spark, d, path):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    trials = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("key"))
    chosen = cohort.Selection({"lang": ["EN", "fr"]}, 5, 8, 120, strict=False)
    return cohort.build_bank(docs.join(v, "doc_id", "left_semi"), v.join(docs, "doc_id", "left_semi"), path, "doc_id", "source", F.array(F.col("doc_id").cast("string")), trials, docs.where("lang = 'es'"), chosen)


@query("l8_whole_bank", f"{BANK} SELECT place, doc_id, source, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 5) AS last FROM b")
def l8_bank(spark, d):
    """The bank's rows as written: place, document, owner and ends of the unit vector."""
    path = fresh_path(spark)
    cohort_parts(spark, d, path)
    return arrays.read_bank(spark, path).select("place", "doc_id", "source", F.round(F.element_at("values", 1).cast("double"), 5).alias("first"), F.round(F.element_at("values", 64).cast("double"), 5).alias("last"))


@query("l8_bank_summary", f"{BANK} SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM f) AS after_filters, (SELECT count(*) FROM a) AS after_trials, count(*) AS selected_rows, count(DISTINCT source) AS selected_owners, (SELECT count(*) FROM a) - (SELECT count(*) FROM c WHERE n >= 5) AS excluded_by_least, (SELECT count(*) FROM c WHERE n >= 5 AND turn > 8) AS excluded_by_most, (SELECT count(*) FROM l) - count(*) AS excluded_by_total, count(DISTINCT source) FILTER (source IN (SELECT source FROM documents WHERE lang = 'es')) AS shared_owners FROM b")
def l8_summary(spark, d):
    return cohort_parts(spark, d, fresh_path(spark)).drop("excluded_by_filters", "excluded_by_trials", "width", "fallback_used")
