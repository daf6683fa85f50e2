"""Probability observations, annotations and feature rows derived from the event and embedding tables,
in Spark and, with the same integer arithmetic, as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoprob.functions.probability import normalized

CLASSES = ("click", "error", "purchase", "signup", "view")
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01
#: Components of the feature rows: whole embedding vectors.
N_FEATURES = 64
#: Seconds: baseline is before, effect after.
BASELINE = (0.0, 864_000.0)
EFFECT = (864_000.0, 10_000_000.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str, factor: int = 3, decoder: str = "a") -> DataFrame:
    """One row for each event: stream, subject, fold, time in seconds, true label and probabilities."""
    e = table(spark, sf_dir, "events")
    label = F.coalesce(*[F.when(F.col("event_type") == c, F.lit(i)) for i, c in enumerate(CLASSES)])
    base = e.select(
        "event_id", F.col("user_id").alias("stream_id"), (F.col("user_id") % 5).alias("fold"), F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("subject"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6).alias("time"),
        label.alias("true_label"), F.col("event_type").alias("true_class"), "value",
    )
    w = [1 + (F.col("event_id") * (k + factor)) % 17 + F.when(F.col("true_label") == k, 6).otherwise(0) for k in range(len(CLASSES))]
    weights = base.select("*", F.array(*[x.cast("double") for x in w]).alias("w"))
    p = normalized(F.col("w"))
    return weights.select(*base.columns, F.lit(decoder).alias("decoder"), F.lit("calibrated").alias("emission_mode"), p.alias("p"), F.array(*map(F.lit, CLASSES)).alias("classes"))


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).unionByName(obs(spark, sf_dir, 5, "b"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).where("true_class = 'purchase'").select("stream_id", F.col("event_id").alias("annotation_id"), F.col("time").alias("onset_time"), F.col("true_class").alias("stimulus_class"), "subject")


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows: domain 0 is the held-out target."""
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(F.col("vec_id").alias("row_id"), x.alias("x"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 4).cast("int").alias("domain"), F.when(F.col("vec_id") % 4 == 0, "target").otherwise("source").alias("role"))


def _weights(factor: int) -> str:
    return ", ".join(f"1 + (event_id * {k + factor}) % 17 + CASE WHEN true_label = {k} THEN 6 ELSE 0 END AS w{k}" for k in range(5))


def _obs_sql(name: str, factor: int, decoder: str) -> str:
    p = ", ".join(f"CAST(w{k} AS DOUBLE) / CAST(w0 + w1 + w2 + w3 + w4 AS DOUBLE) AS p{k}" for k in range(5))
    conf = "greatest(p0, p1, p2, p3, p4)"
    pred = " ".join(f"WHEN p{k} = {conf} THEN {k}" for k in range(5))
    return f"""{name}_w AS (SELECT *, {_weights(factor)} FROM ev),
{name}_p AS (SELECT event_id, stream_id, fold, subject, time, true_label, true_class, value, '{decoder}' AS decoder, {p} FROM {name}_w),
{name} AS (SELECT *, {conf} AS conf, CASE {pred} END AS pred, CASE true_label {' '.join(f'WHEN {k} THEN p{k}' for k in range(5))} END AS ptrue FROM {name}_p)"""


EV_SQL = f"""ev AS (SELECT event_id, user_id AS stream_id, user_id % 5 AS fold, 'S' || CAST(user_id % 10 AS VARCHAR) AS subject,
  (epoch_us(ts) - {EPOCH_US}) / 1e6 AS time, CASE event_type {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES))} END AS true_label, event_type AS true_class, value FROM events)"""
OBS_SQL = f"{EV_SQL},\n{_obs_sql('obs', 3, 'a')}"
BOTH_SQL = f"{OBS_SQL},\n{_obs_sql('obs_b', 5, 'b')},\nboth_obs AS (SELECT * FROM obs UNION ALL SELECT * FROM obs_b)"
#: Long rows (row_id, pos, v, label, domain, role) of the feature table.
FEAT_SQL = """feat AS (SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label, CAST(vec_id % 4 AS INTEGER) AS domain, CASE WHEN vec_id % 4 = 0 THEN 'target' ELSE 'source' END AS role,
  """ + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(N_FEATURES)) + """ FROM embeddings),
longf AS (""" + " UNION ALL ".join(f"SELECT row_id, label, domain, role, {i} AS pos, x{i} AS v FROM feat" for i in range(N_FEATURES)) + ")"
