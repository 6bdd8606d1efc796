"""Sources and sinks: Parquet, CSV and JSON lines, manifests, and resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORY_SCHEMA = "id long, story string, word_count long, source string"
COMPARISON_SCHEMA = "marker string, mean_orig double, mean_rewrite double, mean_diff double, pct_change double, wilcoxon_stat double, p_value double, significant boolean, cohens_d double, direction string, p_value_fdr double, significant_fdr boolean"
RESPONSE_SCHEMA = "custom_id string, error string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"


def load_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet table; a missing path raises when it is read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def save_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Overwrite a Parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def save_csv(df: DataFrame, path: str, single: bool = True) -> str:
    """CSV with a header; results are summaries, so one file by default."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def load_comparison(spark: SparkSession, path: str, keep_id: bool = False) -> DataFrame:
    """A comparison table; the id pseudo-marker goes unless asked for."""
    df = load_csv(spark, path, COMPARISON_SCHEMA)
    return df if keep_id else df.filter("marker <> 'id'")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return load_csv(spark, path, "story_id long, test string")


def in_manifest(df: DataFrame, manifest: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(manifest.select(F.col("story_id").alias(id_col)).distinct(), id_col, "left_semi")


def save_requests(df: DataFrame, path: str, model: str, prompt: str, max_tokens: int = 4096, temperature: float = 0.7) -> str:
    """Batch requests as JSON lines from (id, text); the prompt names the place of the text as {text}."""
    content = F.replace(F.lit(prompt), F.lit("{text}"), F.col("text"))
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"), F.lit(max_tokens).alias("max_completion_tokens"), F.lit(temperature).alias("temperature"))
    line = F.to_json(F.struct(F.col("id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def parse_responses(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the batch responses without an error."""
    rows = spark.read.text(path).select(F.from_json("value", RESPONSE_SCHEMA).alias("r")).filter("r.error is null and r.response is not null")
    return rows.select(F.expr("try_cast(r.custom_id as bigint)").alias("id"), F.trim(F.col("r.response.body.choices")[0]["message"]["content"]).alias("text"))


def rewrite_column(label: str, cleaned: bool = False, variant: str = "") -> str:
    return f"rewrite_{label}{variant}{'_clean' if cleaned else ''}"


def to_long(wide: DataFrame, id_col: str = "id", prefix: str = "rewrite_") -> DataFrame:
    """(id, model, text) from one nullable column for each model."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot([id_col], cols, "model", "text").withColumn("model", F.expr(f"substring(model, {len(prefix) + 1})"))


def to_wide(rows: DataFrame, models: list[str], id_col: str = "id") -> DataFrame:
    return rows.groupBy(id_col).pivot("model", models).agg(F.first("text", ignorenulls=True)).select(id_col, *(F.col(m).alias(rewrite_column(m)) for m in models))


def append_missing(spark: SparkSession, todo: DataFrame, path: str, compute, keys: list[str]) -> DataFrame:
    """Resume: compute and append only the rows whose keys the sink does not hold yet; the whole sink is returned."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        todo = todo.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def append_in_batches(spark: SparkSession, todo: DataFrame, path: str, compute, keys: list[str], batch_rows: int = 25) -> DataFrame:
    """Resume with a checkpoint for about every ``batch_rows`` rows: each batch is appended before the next one is computed.

    Batches are classes of a hash of the keys, so a run that ended between two of
    them goes on with what is missing. Choose ``batch_rows`` so that there are few
    batches; each is a job over its share of the input.
    """
    parts = -(-todo.count() // batch_rows)
    for k in range(parts):
        append_missing(spark, todo.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == k), path, compute, keys)
    return spark.read.parquet(path) if parts else compute(todo)


def load_pair(spark: SparkSession, path: str, condition: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Marker tables of the originals and of one model's rewrites, of a sink partitioned by (condition, model)."""
    rows = spark.read.parquet(path).filter(F.col("condition") == condition)
    return rows.filter("model = 'original'").drop("condition", "model"), rows.filter(F.col("model") == model).drop("condition", "model")
