"""File sources and sinks: cached loads, tolerant JSON, CSV with JSON columns, manifests, archives, models.

Paths may be on any file system that Spark reads. Readers take declared schemas, so nothing is scanned to infer one.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.utils import AnalysisException

#: Declared record schemas.
SCHEMAS = {
    "commits": "sha string, message_head string, author_name string, author_email string, author_date timestamp, parents array<string>, html_url string",
    "pull_requests": "number long, title string, user string, state string, created_at timestamp, closed_at timestamp, merged_at timestamp, merge_commit_sha string, html_url string, commits array<struct<sha:string,message_head:string>>",
    "manifest": "relpath string, size long, mtime timestamp, mime string, is_text boolean, sha256 string, source_archive string",
    "nodes": "id string, node_type string, label string, path string, qualified_name string, lineno int, sha string, number long, attrs map<string,string>",
    "edges": "source string, target string, type string, count long, provenance string",
    "summaries": "node_id string, one_liner string, bullets array<string>, raw_output string",
    "transactions": "invoice_no string, stock_code string, description string, quantity long, invoice_date timestamp, unit_price double, customer_id long, country string",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_or_build(spark: SparkSession, cache: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The parquet copy at ``cache``; where there is none it is built, written and read."""
    if not exists(spark, cache):
        build().write.mode("errorifexists").parquet(cache)
    return spark.read.parquet(cache)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; damaged values are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or one document per file; a missing path gives an empty table, damaged and blank lines give no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(f"{schema}, _damaged string").option("columnNameOfCorruptRecord", "_damaged").option("multiLine", not lines).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return rows.where("_damaged is null").drop("_damaged")


def with_json_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, as CSV holds no nested values; the keys of a map column are sorted."""

    def fixed(f) -> Column:
        return F.map_from_entries(F.array_sort(F.map_entries(f.name))) if isinstance(f.dataType, MapType) else F.col(f.name)

    return df.select(*(F.to_json(fixed(f)).alias(f.name) if isinstance(f.dataType, ArrayType | MapType | StructType) else F.col(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    with_json_columns(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, references): the references of a CSV grouped by node, in text order."""
    rows = read_csv(spark, path, "node_id string, reference string").where("node_id is not null and reference is not null")
    return rows.groupBy("node_id").agg(F.array_sort(F.collect_list("reference")).alias("references"))


def flatten_commits(raw: DataFrame) -> DataFrame:
    """Records of a commits API (sha, commit{message, author{name, email, date}}, parents[{sha}], html_url), flat, with the first line of the message."""
    c = F.col("commit")
    return raw.select(
        "sha", F.substring_index(c["message"], "\n", 1).alias("message_head"), c["author"]["name"].alias("author_name"), c["author"]["email"].alias("author_email"),
        F.try_to_timestamp(c["author"]["date"]).alias("author_date"), F.transform("parents", lambda p: p["sha"]).alias("parents"), "html_url",
    )


def flatten_pull_requests(raw: DataFrame) -> DataFrame:
    """Pull requests with their commits reduced to hash and first line."""
    one = lambda c: F.struct(c["sha"].alias("sha"), F.substring_index(c["commit"]["message"], "\n", 1).alias("message_head"))
    return raw.select("number", "title", F.col("user")["login"].alias("user"), "state", "merge_commit_sha", "html_url", F.coalesce(F.transform("commits", one), F.array().cast("array<struct<sha:string,message_head:string>>")).alias("commits"))


LOG_FORMAT = "%H%x1f%an%x1f%ae%x1f%aI%x1f%P%x1f%s"


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log file written with LOG_FORMAT; a hash that occurs again keeps its last line."""
    lines = spark.read.text(path).select(F.split("value", "\x1f").alias("p"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).where("size(p) = 6")
    last = lines.groupBy(F.col("p")[0].alias("sha")).agg(F.max_by("p", F.struct("f", "i")).alias("p"))
    return last.select("sha", F.col("p")[5].alias("message_head"), F.col("p")[1].alias("author_name"), F.col("p")[2].alias("author_email"), F.try_to_timestamp(F.col("p")[3]).alias("author_date"), F.filter(F.split(F.col("p")[4], " "), lambda x: x != "").alias("parents"))


#: MIME types by ending.
MIME = {"py": "text/x-python", "md": "text/markdown", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "html": "text/html", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "zip": "application/zip", "png": "image/png", "pdf": "application/pdf"}


def mime_of(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(path, ".", -1))), F.lit("application/octet-stream"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file below the folder: size, time, type, hash, and whether it is text (by type, else no NUL in the first 2 KiB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    rel = F.regexp_extract("path", rf"/{re.escape(root)}/(.*)$", 1)
    mime = mime_of(rel)
    no_nul = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 2048)), "(..)", "$1 ")) == 0
    return files.select(rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), mime.alias("mime"), (mime.startswith("text/") | mime.isin("application/json", "application/xml", "application/yaml") | no_nul).alias("is_text"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("source_archive"))


def expanded_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows of the members of zip files; a damaged archive gives none. One archive is opened by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                data = z.read(m)
                                rows.append((m.filename, len(data), datetime(*m.date_time), b"\0" not in data[:2048], hashlib.sha256(data).hexdigest(), path))
                except (zipfile.BadZipFile, OSError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["relpath", "size", "mtime", "is_text", "sha256", "source_archive"])

    zips = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    members = zips.mapInPandas(run, "relpath string, size long, mtime timestamp, is_text boolean, sha256 string, source_archive string")
    return members.select("relpath", "size", "mtime", mime_of(F.col("relpath")).alias("mime"), "is_text", "sha256", "source_archive")


def merged_manifest(base: DataFrame, more: DataFrame) -> DataFrame:
    """base and those rows of more whose relpath it does not have."""
    return base.unionByName(more.join(base.select("relpath"), "relpath", "left_anti").select(*base.columns))


def text_of_html(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags off, common entities read, blanks single."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"<[^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def append_scores(scored: DataFrame, table: str, started: float | None = None) -> None:
    """Scored rows with a timestamp and the latency in seconds since ``started`` (a time of the clock; null without) appended to a table; where it is missing it is made first, empty and with their columns."""
    spark = scored.sparkSession
    latency = F.lit(None).cast("double") if started is None else (F.unix_micros(F.current_timestamp()) / 1e6 - F.lit(float(started))).cast("double")
    rows = scored.withColumn("scored_at", F.current_timestamp()).withColumn("latency", latency)
    if not spark.catalog.tableExists(table):
        rows.limit(0).write.saveAsTable(table)
    rows.select(*spark.table(table).columns).write.mode("append").saveAsTable(table)


def mapped_commits(shas: DataFrame, known: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(sha, prs): the numbers of known (sha, number) for each sha, joined and ordered; only those it does not have go through ``lookup`` (a table of sha to a table of sha and number), and what that does not know, or a look-up that fails, gives an empty list."""
    rest = shas.join(known.select("sha").distinct(), "sha", "left_anti")
    try:
        more = lookup(rest).select("sha", "number")
        more.schema  # noqa: B018 - a look-up that cannot be planned fails here
    except Exception:  # noqa: BLE001 - whatever the service does, the commits stay
        more = known.select("sha", "number").limit(0)
    found = known.select("sha", "number").unionByName(more).groupBy("sha").agg(F.array_join(F.transform(F.array_sort(F.collect_set("number")), lambda x: x.cast("string")), ",").alias("prs"))
    return shas.join(found, "sha", "left").select("sha", F.coalesce("prs", F.lit("")).alias("prs"))


def serving_model(models: DataFrame) -> DataFrame:
    """The model version in use: the second newest by the number behind the last underscore (the only one where there is one)."""
    at = F.try_to_number(F.substring_index("name", "_", -1), F.lit("999999999999999999"))
    total = Window.partitionBy("family")
    ranked = models.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc(at), F.desc("name")))).withColumn("n", F.count("*").over(total))
    return ranked.where("r = least(2, n)").select("family", "name")
