"""M8: streaming queries.  Each runs a Structured Streaming query over a
fixture table read as a file stream, to completion (``availableNow``), into
a Parquet sink in the shared checkpoint folder, and returns the sink as a
DataFrame.  Oracles are the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import structure_tag
from quarry.functions.vectors import cosine, logit_margin
from quarry.operators.centroids import centroids
from quarry.operators.trigger import fit_band, score_anomaly
from quarry.plans import sweep_plans  # noqa: F401  (registers the batch EMA oracle)
from quarry.plans import trigger_plans
from quarry.plans.registry import REGISTRY, register, rounded
from quarry.plans.trigger_plans import SLICE_MAX_MARGIN, SLICE_THRESHOLD, SLICE_WEIGHTS
from quarry.sources.tables import embeddings, table
from quarry.streaming import stateful as ST
from quarry.streaming.runner import run_available_now, table_stream


@register("stream_ema", operators=("STR-6", "STR-1", "WIN-1"),
          sql=REGISTRY["ema"].sql if "ema" in REGISTRY else None)
def q_stream_ema(spark, sf_dir):
    s = table_stream(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = run_available_now(ST.stream_ema(s, "user_id", ["ts", "event_id"], "value", "event_id"),
                            name="stream-ema")
    return rounded(out.select("event_id", "user_id", "ema_score"))


@register("stream_count_windows", operators=("STR-7", "WIN-10"), sql="""
SELECT event_id, event_type,
       CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / 200)
            AS BIGINT) AS window,
       CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT)
         AS position
FROM events""")
def q_stream_count_windows(spark, sf_dir):
    s = table_stream(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return run_available_now(ST.stream_count_windows(s, "event_type", ["ts", "event_id"],
                                                     "event_id", 200), name="stream-cw")


@register("stream_latest", operators=("STR-11",), sql="""
SELECT event_type, arg_max(event_id, event_id) AS event_id, arg_max(user_id, event_id) AS user_id,
       CAST(round(arg_max(value, event_id), 6) AS DOUBLE) AS value
FROM events GROUP BY event_type""")
def q_stream_latest(spark, sf_dir):
    s = table_stream(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    out = run_available_now(ST.stream_latest(s, "event_type", "event_id", ["user_id", "value"]),
                            name="stream-latest")
    # the sink holds every change; the current tap is the newest per key
    latest = out.groupBy("event_type").agg(F.max_by(F.struct("event_id", "user_id", "value"),
                                                    "event_id").alias("r"))
    return rounded(latest.select("event_type", "r.event_id", "r.user_id", "r.value"))


@register("latest_per_key", operators=("STR-11",), sql="""
SELECT event_type, arg_max(event_id, event_id) AS event_id, arg_max(user_id, event_id) AS user_id,
       CAST(round(arg_max(value, event_id), 6) AS DOUBLE) AS value
FROM events GROUP BY event_type""")
def q_latest_per_key(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    r = ev.groupBy("event_type").agg(F.max_by(F.struct("event_id", "user_id", "value"),
                                              "event_id").alias("r"))
    return rounded(r.select("event_type", "r.event_id", "r.user_id", "r.value"))


@register("stream_windows", operators=("STR-10",), sql="""
WITH w AS (SELECT date_trunc('hour', ts) AS ws, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 1 hour, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, n
FROM w WHERE ws + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 1 hour FROM events)""")
def q_stream_windows(spark, sf_dir):
    s = table_stream(spark, sf_dir, "events").select("ts", "event_type")
    out = run_available_now(ST.event_time_counts(s, "ts", "event_type", "1 hour", "1 hour"),
                            name="stream-windows")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.select(F.date_format("window_start", fmt).alias("window_start"),
                      F.date_format("window_end", fmt).alias("window_end"), "event_type", "n")


@register("stream_trigger", operators=("STR-2", "STR-1", "FN-9", "JOIN-11"),
          sql=REGISTRY["trigger_samples"].sql)
def q_stream_trigger(spark, sf_dir):
    """Online trigger: the frozen band and the label centroids are fitted in
    batch; the stream of sample vectors is scored with stream-static joins."""
    comp = trigger_plans.sample_components(spark, sf_dir)
    band = fit_band(comp, "similarity", where=F.col("quality") == 1)
    band = band.collect()  # one row: the frozen band becomes two literals
    lo, hi = band[0]["band_lo"], band[0]["band_hi"]
    cents = centroids(embeddings(spark, sf_dir), "label")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), structure_tag("source").alias("bucket"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"),
                                                   "quality", "toxic")
    s = table_stream(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("v"),
        "label")
    s = (s.join(cents.select("label", "centroid"), "label")
         .select("sample_id", logit_margin("v").alias("margin"),
                 cosine("v", "centroid").alias("similarity"))
         .join(docs, "sample_id").join(labels, "sample_id", "left")
         .withColumn("bleu", F.lit(1.0)).withColumn("rouge", F.lit(1.0)))
    band_df = spark.range(1).select(F.lit(lo).cast("double").alias("band_lo"),
                                    F.lit(hi).cast("double").alias("band_hi"))
    scored = score_anomaly(s, band_df, weights=SLICE_WEIGHTS, max_margin=SLICE_MAX_MARGIN,
                           threshold=SLICE_THRESHOLD)
    out = run_available_now(scored.select("sample_id", "bucket", "margin", "similarity",
                                          "anomaly_score", "trigger", "quality", "toxic"),
                            name="stream-trigger")
    return rounded(out)


@register("stream_trigger_full", operators=("STR-2", "STR-1", "FN-9", "JOIN-11"))
def q_stream_trigger_full(spark, sf_dir):
    """``trigger_full`` online: vectors stream in, the pairs with their overlap
    scores are a static side, and a pair is scored when the vector of its
    conversation arrives."""
    comp = trigger_plans.sample_components(spark, sf_dir)
    band = fit_band(comp, "similarity", where=F.col("quality") == 1).collect()[0]  # one row
    cents = centroids(embeddings(spark, sf_dir), "label")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), structure_tag("source").alias("bucket"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality", "toxic")
    s = table_stream(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("conv_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    s = (s.join(cents.select("label", "centroid"), "label")
         .select("conv_id", logit_margin("v").alias("margin"), cosine("v", "centroid").alias("similarity"))
         .join(docs, "conv_id").join(labels, "conv_id", "left")
         .join(trigger_plans.pair_scores(spark, sf_dir), "conv_id"))
    band_df = spark.range(1).select(F.lit(band["band_lo"]).cast("double").alias("band_lo"),
                                    F.lit(band["band_hi"]).cast("double").alias("band_hi"))
    scored = score_anomaly(s, band_df, weights=SLICE_WEIGHTS, max_margin=SLICE_MAX_MARGIN,
                           threshold=SLICE_THRESHOLD, gold="gold")
    return rounded(run_available_now(scored.select(*trigger_plans.FULL_COLUMNS), name="stream-trigger-full"))


def triggered_stream(spark, sf_dir):
    """Samples that fire the trigger, as a stream: vectors stream in, the
    band / centroids / documents are static sides."""
    from quarry.functions.text import keywords
    comp = trigger_plans.sample_components(spark, sf_dir)
    band = fit_band(comp, "similarity", where=F.col("quality") == 1).collect()[0]
    cents = centroids(embeddings(spark, sf_dir), "label")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("bucket"), "text")
    s = table_stream(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("v"),
        "label")
    s = (s.join(cents.select("label", "centroid"), "label")
         .select("sample_id", "v", logit_margin("v").alias("margin"),
                 cosine("v", "centroid").alias("similarity"))
         .withColumn("bleu", F.lit(1.0)).withColumn("rouge", F.lit(1.0))
         .join(docs, "sample_id"))
    band_df = spark.range(1).select(F.lit(band["band_lo"]).cast("double").alias("band_lo"),
                                    F.lit(band["band_hi"]).cast("double").alias("band_hi"))
    scored = score_anomaly(s, band_df, weights=SLICE_WEIGHTS, max_margin=SLICE_MAX_MARGIN,
                           threshold=SLICE_THRESHOLD)
    # keywords cost far more than the join: only triggered rows get them, dealt evenly
    return scored.filter("trigger").repartition("sample_id").select("bucket", "sample_id", F.col("sample_id").alias("seq"),
                                           F.col("v").alias("embedding"), keywords("text").alias("keywords"))


@register("stream_clusters", operators=("STR-3", "STR-4", "STR-5", "CLU-4", "CLU-5", "FLT-5",
                                        "FLT-6", "SNK-9"))
def q_stream_clusters(spark, sf_dir):
    """Triggered samples routed to per-language buckets and clustered
    incrementally (parity mode: an attempt on every row from 25 on)."""
    from quarry.streaming.clusters import stream_clusters
    ev = stream_clusters(triggered_stream(spark, sf_dir), sim_threshold=0.45,
                         stability_check=True, merge=False, attempt_every_row=True)
    return run_available_now(ev, name="stream-clusters")


@register("stream_clusters_merge", operators=("CLU-6", "CLU-7", "JOIN-13"))
def q_stream_clusters_merge(spark, sf_dir):
    """The ablation with merging on (centre cosine >= 0.8)."""
    from quarry.streaming.clusters import stream_clusters
    ev = stream_clusters(triggered_stream(spark, sf_dir), sim_threshold=0.45,
                         stability_check=True, merge=True, attempt_every_row=True)
    return run_available_now(ev, name="stream-clusters-merge")


@register("stream_warm_start", operators=("STR-9", "STR-4", "STR-3", "SNK-9"))
def q_stream_warm_start(spark, sf_dir):
    """Run the clustering stream over the earlier half of the vectors, take each
    bucket's last state rows from its sink, and start a second run over the later
    half from that state: stable buckets assign rows to their promoted clusters
    on the fast path."""
    from quarry.streaming.clusters import last_states, stream_clusters_tws
    p = dict(sim_threshold=0.45, stability_check=True, merge=False, attempt_every_row=True)
    half = embeddings(spark, sf_dir).agg(F.max("vec_id")).first()[0]
    half = 0 if half is None else half // 2
    rows = triggered_stream(spark, sf_dir)
    first = run_available_now(stream_clusters_tws(rows.where(F.col("sample_id") <= half), **p), name="warm-1")
    second = run_available_now(stream_clusters_tws(rows.where(F.col("sample_id") > half), last_states(first), **p), name="warm-2")
    return second.filter(F.col("event") != "state").drop("state_json")


@register("stream_cluster_tables", operators=("STR-3", "STR-4", "STR-5", "STR-9", "CLU-4", "CLU-5", "FLT-5", "FLT-6", "SNK-9"))
def q_stream_cluster_tables(spark, sf_dir):
    """The clustering stream with its state in tables, in two runs: the first
    over the earlier half of the vectors, the second over the later half,
    started from the state that the first has stored.  Events of both."""
    import uuid

    from quarry.session import checkpoint_dir
    from quarry.streaming.cluster_tables import run_cluster_tables
    half = embeddings(spark, sf_dir).agg(F.max("vec_id")).first()[0]
    half = 0 if half is None else half // 2
    rows = triggered_stream(spark, sf_dir)
    roots = [f"{checkpoint_dir(spark).rstrip('/')}/cluster-tables-{uuid.uuid4().hex}" for _ in range(2)]
    first = run_cluster_tables(rows.where(F.col("sample_id") <= half), roots[0])
    second = run_cluster_tables(rows.where(F.col("sample_id") > half), roots[1], start=roots[0])
    return first.events(spark).unionByName(second.events(spark))
