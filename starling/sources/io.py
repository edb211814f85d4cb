"""Sources and sinks: CSV with rejects, Parquet, LibSVM, prediction files, metrics, reuse of artifacts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T


_OWN_FOLDER: dict[str, str] = {}
_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may leave the setting out; its one process gets a temporary folder then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN_FOLDER:
            _OWN_FOLDER[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        root = _OWN_FOLDER[context.applicationId]
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Deletes what was written below scratch paths so far and returns how many there were; DataFrames that read them end with it."""
    n = len(_WRITTEN)
    for path in _WRITTEN[:n]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[:n]
    return n


def read_text_csv(spark: SparkSession, path: str, columns: list[str], infer: bool = False) -> DataFrame:
    """A CSV with header, quoted multi-line text and doubled quotes; all strings unless ``infer``. Each file is one task: large ones are for quoted_csv.read_quoted_csv."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if infer:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts columns; text that cannot be cast becomes null."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})


def reject_rows(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows; a condition that is null counts as false."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int | None = None) -> None:
    writer = df.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_libsvm(df: DataFrame, path: str, label: str, values: str) -> None:
    """label and an array<double> column as LibSVM text."""
    df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(values).cast("array<double>")).alias("features")).write.mode("overwrite").format("libsvm").save(path)


def read_libsvm(spark: SparkSession, path: str, width: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", width).load(path)


def sparse_long(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, idx, val) of the entries of an array column that are not 0."""
    return df.select(key, F.posexplode(values).alias("idx", "val")).where("val <> 0")


def check_same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """missing, extra: ids of ``left`` that ``right`` lacks, and the other way round."""
    missing = left.select(key).join(right.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return missing.crossJoin(right.select(key).join(left.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("extra")))


def write_predictions(df: DataFrame, path: str, key: str = "id", value: str = "rating") -> None:
    """The prediction file: id and rating with six decimals."""
    write_csv(df.select(F.col(key).alias("id"), F.format_string("%.6f", F.col(value)).alias("rating")), path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds rows (run, name, value) to the metrics table."""
    df.select("run", "name", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """name and value of the last run that has each metric."""
    return spark.read.parquet(path).groupBy("name").agg(F.max_by("value", "run").alias("value"))


def write_observed(df: DataFrame, path: str, valid=None, nulls: Sequence[str] = ()) -> dict:
    """Writes the rows for which ``valid`` holds and returns what the write saw: rows, rejected, and nulls of columns. No second pass counts anything."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("__ok")).alias("rejected"), *[F.count_if(F.col(c).isNull()).alias(f"nulls.{c}") for c in nulls]]
    df.withColumn("__ok", ok).observe(seen, *counts).where("__ok").drop("__ok").write.mode("overwrite").parquet(path)
    got = seen.get
    return {"rows": got["rows"], "rejected": got["rejected"], "nulls": {c: got[f"nulls.{c}"] for c in nulls}}


def merge_metrics(old: dict, new: dict) -> dict:
    """Nested metrics: what only one side has stays, dictionaries are merged, of two other values the new one stays."""
    out = dict(old)
    for name, value in new.items():
        out[name] = merge_metrics(out[name], value) if isinstance(value, dict) and isinstance(out.get(name), dict) else value
    return out


def flat_metrics(nested: dict, prefix: str = "") -> dict:
    """Numbers under dotted names."""
    out: dict = {}
    for name, value in nested.items():
        out |= flat_metrics(value, f"{prefix}{name}.") if isinstance(value, dict) else {f"{prefix}{name}": value}
    return out


def materialize(df: DataFrame, path: str, reuse: bool = True) -> DataFrame:
    """Writes ``df`` to ``path`` unless a finished table is there already (and ``reuse``), and reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not (reuse and place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
