"""Reading, writing and standardizing probability-observation tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBABILITY = re.compile(r"prob_class_(-?\d+)\Z")
#: Order of the columns of a standard table; others follow.
STANDARD = ("subject", "decoder", "emission_mode", "fold", "sequence_id", "time", "true_label", "predicted_label", "confidence")
METRICS = ("accuracy", "log_loss", "brier", "ece")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or, unset and on a
    local master only, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = getattr(shared_path, "own", None) or tempfile.mkdtemp(prefix="spark-tables-")
        shared_path.own = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and reread: ends the lineage of an iteration so that a lost executor costs only its tasks."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def probability_columns(columns: Sequence[str]) -> list[str]:
    """``prob_class_*`` columns by numeric suffix; two columns of one suffix are an error."""
    found = sorted((int(m[1]), c) for c in columns if (m := PROBABILITY.match(c)))
    labels = [n for n, _ in found]
    if len(set(labels)) < len(labels):
        raise ValueError(f"probability columns of the same class: {[c for _, c in found]}")
    if not found:
        raise ValueError("no probability columns")
    return [c for _, c in found]


def packed(df: DataFrame) -> DataFrame:
    """Wide ``prob_class_k`` columns as the array ``p``."""
    columns = probability_columns(df.columns)
    return df.withColumn("p", F.array(*[F.col(c).cast("double") for c in columns])).drop(*columns)


def wide(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The array ``p`` as ``prob_class_k`` columns, with class names as ``class_k``."""
    p = [F.get("p", F.lit(i)).alias(f"prob_class_{i}") for i in range(len(classes))]
    return df.select(*[c for c in df.columns if c not in ("p", "classes")], *p, *[F.lit(c).alias(f"class_{i}") for i, c in enumerate(classes)])


def with_defaults(df: DataFrame, stream: bool = False) -> DataFrame:
    """Missing identifiers: the sequence from the sample index, the subject from group columns or the
    file's name, fixed decoder and emission mode; streams fall back to the file's name."""
    stem = F.regexp_extract(F.col("source_file"), r"([^/]+?)(\.[^.]*)?$", 1)
    has = set(df.columns)
    out = df
    if "sequence_id" not in has and "sample_index" in has:
        out = out.withColumn("sequence_id", F.col("sample_index"))
    elif stream and "sequence_id" not in has and "stream_id" not in has:
        out = out.withColumn("stream_id", stem)
    if "subject" not in has:
        chain = [F.col(c).cast("string") for c in ("group", "outer_test_groups") if c in has]
        out = out.withColumn("subject", F.coalesce(*chain, stem))
    for c, v in (("decoder", "decoder"), ("emission_mode", "calibrated")):
        if c not in has:
            out = out.withColumn(c, F.lit(v))
    return out


def read_observations(spark: SparkSession, path: str | list[str], form: str = "csv", stream: bool = False, normalize: bool = False) -> DataFrame:
    """Observation files with default identifiers and the probabilities as the array ``p``."""
    from chronoprob.functions.probability import normalized

    reader = spark.read.option("header", True).option("inferSchema", True) if form == "csv" else spark.read
    raw = reader.format(form).load(path)
    raw = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
    if "time" not in raw.columns:
        raise ValueError("observations need the column time")
    out = packed(with_defaults(raw.withColumn("time", F.col("time").cast("double")), stream))
    return out.withColumn("p", normalized(F.col("p"), 1e-15)) if normalize else out


RESULT_SCHEMA = "subject string, decoder string, fold long, time double, accuracy double, log_loss double, brier double, ece double, n_test long"


def read_results(spark: SparkSession, path: str | list[str], schema: str = RESULT_SCHEMA) -> DataFrame:
    """Fold-metric CSV files with a fixed schema; ``time`` and the metrics have to be there."""
    found = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in ("time", *METRICS) if c not in found]:
        raise ValueError(f"results lack {missing}")
    return spark.read.option("header", True).schema(schema).csv(path).select("*", F.col("_metadata.file_name").alias("source_file"))


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite").format(form)
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def standardized(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Blank or null cells get defaults; ``time``, ``test_time`` and ``train_time`` fill one another;
    standard columns come first, others after them."""
    out = df
    times = [c for c in ("time", "test_time", "train_time") if c in df.columns]
    if times:
        known = F.coalesce(*[F.col(c).cast("double") for c in times])
        for c in ("time", "test_time", "train_time"):
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), known) if c in df.columns else known)
    for c, v in defaults.items():
        kept = F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(kept, F.lit(v)))
    first = [c for c in STANDARD if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def from_decoded(folds: DataFrame, label: str = "true_label") -> DataFrame:
    """Predicted label and class, confidence, probability of the true class and correctness of rows with
    ``p`` and ``classes``."""
    from chronoprob.functions import probability as P

    p = F.col("p")
    out = folds.withColumn("predicted_label", P.predicted_index(p)).withColumn("confidence", P.confidence(p))
    out = out.withColumn("probability_true_class", P.true_probability(p, F.col(label))).withColumn("predicted_class", F.get("classes", F.col("predicted_label")))
    return out.withColumn("is_correct", F.col("predicted_label") == F.col(label))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, with the union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def row_hash(*columns: str) -> Column:
    """First 16 hex digits of the SHA-256 of the row as compact JSON with sorted keys."""
    return F.left(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256), F.lit(16))


def stamped(df: DataFrame, **values) -> DataFrame:
    """Constant columns, such as split, seed and the hashes of preprocessing and model."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def expanded_manifest(spark: SparkSession, id_ranges: str, splits: Sequence[str], template: str) -> DataFrame:
    """(participant, split, path) for ranges such as ``1-5,8``; ``{participant}`` and ``{split}`` are filled in."""
    spans = [tuple(map(int, (part.split("-") * 2)[:2])) for part in id_ranges.split(",")]
    ids = spark.createDataFrame(spans, "low int, high int").select(F.explode(F.sequence("low", "high")).alias("participant")).distinct()
    rows = ids.withColumn("split", F.explode(F.array(*map(F.lit, splits))))
    path = F.replace(F.replace(F.lit(template), F.lit("{participant}"), F.lpad(F.col("participant").cast("string"), 2, "0")), F.lit("{split}"), F.col("split"))
    return rows.withColumn("path", path)


def window_grid(trials: DataFrame, start: str, stop: str, width: float, stride: float, centered: bool = False) -> DataFrame:
    """Windows of each trial: window i starts at start + i * stride (not by repeated addition)."""
    n = F.floor((F.col(stop) - F.col(start) - F.lit(width)) / F.lit(stride) + 1e-9).cast("int")
    rows = trials.where(n >= 0).withColumn("window_index", F.explode(F.sequence(F.lit(0), n)))
    first = F.col(start) + F.col("window_index") * F.lit(stride)
    shift = F.lit(width / 2 if centered else 0.0)
    return rows.withColumn("window_start", first - shift).withColumn("window_stop", first - shift + F.lit(width))
