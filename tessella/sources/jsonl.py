"""Readers of the record files: instances, decisions, results, aggregates, checkpoints, templates and settings.

A missing file raises DataLoadError; blank lines are skipped; absent keys take the schema's default."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataLoadError(Exception):
    """A source that can't be read; code says which kind (missing, empty, corrupt)."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


CORE = ("instance_id", "text", "label", "dataset", "split")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value of every line that is not blank."""
    if not _exists(spark, path):
        raise DataLoadError("missing", path)
    return spark.read.text(path).where("trim(value) <> ''")


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, text, label, dataset, split (empty where absent) and metadata, a map of all other keys."""
    fields = F.from_json("value", "map<string,string>")
    rows = read_lines(spark, path).select(fields.alias("m"))
    return rows.select(*[F.coalesce(F.col("m")[c], F.lit("")).alias(c) for c in CORE], F.map_filter("m", lambda k, v: ~k.isin(*CORE)).alias("metadata"))


def _place() -> list:
    """Where a line comes from: its file and the start of the part of the file that was read with it."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The last row per key, at the place of the key's first: files by name, lines in their order."""
    cols = [c for c in rows.columns if c not in (key, "_file", "_start")]
    order = rows.withColumn("_at", F.struct("_file", "_start", F.monotonically_increasing_id().alias("line")))
    return order.groupBy(key).agg(F.min("_at").alias("_first"), F.max_by(F.struct(*cols), "_at").alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in cols], "_first").orderBy("_first").drop("_first")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, decision, reason; of an id's lines the last counts."""
    schema = "instance_id string, decision string, reason string"
    rows = read_lines(spark, path).select(F.from_json("value", schema).alias("x"), *_place()).select("x.*", "_file", "_start").where("instance_id is not null")
    return _last(rows, "instance_id")


def read_results(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Result records, typed by the schema or inferred."""
    if not _exists(spark, path):
        raise DataLoadError("missing", path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_aggregates(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document over several lines."""
    if not _exists(spark, path):
        raise DataLoadError("missing", path)
    return spark.read.option("multiLine", True).json(path)


def read_checkpoint(spark: SparkSession, path: str, key: str = "instance_id") -> DataFrame:
    """Checkpointed records as key and value (the JSON line): last wins, in the order of first occurrence."""
    rows = read_lines(spark, path).select(F.get_json_object("value", f"$.{key}").alias(key), "value", *_place()).where(F.col(key).isNotNull())
    return _last(rows, key)


def broken_lines(spark: SparkSession, path: str, key: str = "instance_id") -> int:
    """Lines that are no JSON object with the key; 0 for a sound checkpoint."""
    v = F.try_parse_json("value")
    return read_lines(spark, path).where(v.isNull() | F.try_variant_get(v, f"$.{key}", "string").isNull()).count()


def remaining(work: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows of work that no checkpoint holds."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def model_names(results: DataFrame, models: DataFrame, key: str = "model") -> DataFrame:
    """results with model_name from models (model, model_name); the id itself where there is no name."""
    m = models.select(F.col(key), "model_name").dropDuplicates([key])
    return results.join(m, key, "left").withColumn("model_name", F.coalesce("model_name", key))


def next_in_ring(models: DataFrame, order: str = "position", key: str = "model") -> DataFrame:
    """model, heldout: the model after each in order, the first after the last. For lists of models, not for data."""
    w = Window.orderBy(order)
    n = F.count("*").over(Window.partitionBy())
    at = models.select(key, (F.row_number().over(w) - 1).alias("i"), n.alias("n"))
    return at.join(at.select(F.col(key).alias("heldout"), F.col("i").alias("j")), F.expr("(i + 1) % n = j")).select(key, "heldout")


def read_template(path: str) -> str:
    return Path(path).read_text(encoding="utf-8").strip()


def latest_run(base: str, by: str = "name") -> Path | None:
    """The run folder with the last name or the last change."""
    runs = [p for p in Path(base).iterdir() if p.is_dir()] if Path(base).is_dir() else []
    return max(runs, key=(lambda p: p.name) if by == "name" else (lambda p: p.stat().st_mtime), default=None)


def resolve_template(templates: dict[str, str], strategy: str, dataset: str, n_labels: int) -> str | None:
    """The template of a dataset, else that for several labels, else the general one."""
    names = [f"{strategy}_{dataset}", *([f"{strategy}_multiclass"] if n_labels > 2 else []), strategy]
    return next((templates[n] for n in names if n in templates), None)


def merged_settings(*layers: dict) -> dict:
    """Nested settings; earlier layers win."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_settings(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else out.get(k, v)
    return out


def read_settings(*paths: str) -> dict:
    import yaml

    return merged_settings(*[yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {} for p in paths])
