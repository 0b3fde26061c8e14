"""Sources: folders of files, page text, evaluation runs and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = "id string, category string, question string, answer string, expected_answer string, passed boolean, similarity double"
RUN_SCHEMA = f"meta struct<run_id:string,owner:string,created_at:string>, summary struct<total:long,passed:long,pass_rate:double>, by_category map<string,struct<total:long,passed:long>>, results array<struct<{RESULT.replace(' string', ':string').replace(' boolean', ':boolean').replace(' double', ':double').replace(', ', ',')}>>"


class EmptySourceError(FileNotFoundError):
    """A folder that should hold documents holds none."""


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and status of the PDF files right in ``folder``, by name; the bytes are read only where they are needed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "false").load(folder)
    out = files.select("path", "length", "content").withColumn("status", upload_status(F.col("path"), F.col("length"), F.col("content"))).drop("content").orderBy("path")
    if not out.take(1):
        raise EmptySourceError(f"no PDF files in {folder}")
    return out


def upload_status(path, length, content, most: int = 50 << 20):
    """'ok' or what is wrong with an upload; a bad file never fails the batch."""
    name = F.get(F.reverse(F.split(path, "/")), F.lit(0))
    return F.when(~F.lower(name).endswith(".pdf"), "not a PDF name").when(length == 0, "empty").when(length > most, "too large").when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), "not a PDF").otherwise("ok")


def choose_path(markdown: DataFrame, plain: DataFrame, key: str, least: int = 200, share: float = 0.5) -> DataFrame:
    """key, mode: markdown unless it is missing, short, or much shorter than the plain text."""
    both = plain.groupBy(key).agg(F.sum(F.length("text")).alias("_p")).join(markdown.groupBy(key).agg(F.sum(F.length("text")).alias("_m")), key, "full_outer")
    good = (F.coalesce("_m", F.lit(0)) >= least) & (F.coalesce("_m", F.lit(0)) >= share * F.coalesce("_p", F.lit(0)))
    return both.select(key, F.when(good, "markdown").otherwise("text").alias("mode"))


def page_text(spark: SparkSession, path: str) -> DataFrame:
    """Pages that were extracted already: document_id, page, text."""
    return spark.read.schema("document_id string, page int, text string").json(path)


def eval_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of evaluation runs, newest name first; calibrations and broken files are left out."""
    runs = spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).withColumn("file", F.col("_metadata.file_name"))
    return runs.filter(F.col("summary").isNotNull() & ~F.col("file").contains("calibration")).orderBy(F.desc("file"))


def eval_results(runs: DataFrame) -> DataFrame:
    return runs.select("file", F.explode("results").alias("r")).select("file", "r.*")


def test_set(spark: SparkSession, path: str) -> DataFrame:
    """A test set in JSON or CSV; refused if an entry lacks its category or question."""
    kind = T._parse_datatype_string("id string, category string, question string, expected_answer string, expected_source string")
    read = spark.read.schema(kind)
    out = read.option("multiLine", True).json(path) if path.endswith(".json") else read.option("header", True).csv(path)
    bad = out.filter(F.col("category").isNull() | (F.trim("category") == "") | F.col("question").isNull()).limit(1).count()
    if bad:
        raise ValueError("every entry needs a category and a question")
    return out
