"""File sources and sinks: URL and prompt lists, baselines, history, flat exports, static page trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import urls

# Header cells of URL lists.
HEADER_CELLS = ("url", "urls", "uri", "link", "website")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text or CSV file: blank lines, "#" lines and header cells left out, a scheme added where none is."""
    if path.lower().endswith(".csv"):
        cells = spark.read.csv(path, header=False).select(F.trim(F.col("_c0")).alias("v")).filter(~F.lower("v").isin(*HEADER_CELLS))
    else:
        cells = spark.read.text(path).select(F.trim("value").alias("v"))
    return clean_urls(cells, "v")


def clean_urls(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    return df.filter(v.isNotNull() & (v != "") & ~v.startswith("#")).select(urls.ensure_scheme(v).alias("url"))


def prompt_list(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, category, intent): CSV where the first line has a cell "prompt", else one prompt per line; blank prompts left out."""
    head = spark.read.text(path).limit(1).collect()
    cells = [c.strip().lower() for c in head[0].value.split(",")] if head else []
    if "prompt" in cells:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
        out = raw.select(*[(F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in ("prompt", "category", "intent")])
    else:
        nothing = F.lit(None).cast("string")
        out = spark.read.text(path).select(F.nullif(F.trim("value"), F.lit("")).alias("prompt"), nothing.alias("category"), nothing.alias("intent"))
    return out.filter("prompt is not null")


class HistoryStore:
    """Append-only audit history, partitioned by day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, audits: DataFrame, ts: str = "ts") -> None:
        audits.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def entries(self, url: str, n: int = 20) -> DataFrame:
        """The latest n audits of a URL."""
        return self.read().filter(F.col("url") == url).orderBy(F.desc("ts"), F.desc("id")).limit(n)

    def without(self, url: str, target: str) -> int:
        """Writes the history without a URL to target and returns the number of rows left out."""
        rows = self.read()
        gone = rows.filter(F.col("url") == url).count()
        rows.filter(~F.col("url").eqNullSafe(url)).write.mode("overwrite").partitionBy("day").parquet(target)
        return gone


def save_baseline(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_csv(scores: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header; arrays are joined by commas."""
    arrays = {n for n, t in scores.dtypes if t.startswith("array")}
    scores.select(*[F.array_join(c, ",").alias(c) if c in arrays else F.col(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def export_pages(files: DataFrame, path: str) -> None:
    """Writes (path, markdown) as Parquet by first path segment: one small file per page would not scale."""
    files.withColumn("segment", F.coalesce(F.nullif(F.split("path", "/").getItem(0), F.lit("")), F.lit("root"))).write.mode("overwrite").partitionBy("segment").parquet(path)


def webhook_payload(scores: DataFrame) -> DataFrame:
    """Rows of a notification: the scores as JSON with the time of sending."""
    return scores.select(F.to_json(F.struct(*scores.columns, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"))).alias("payload"))
