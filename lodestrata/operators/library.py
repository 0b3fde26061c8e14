"""A library over time: documents, sessions, messages, replacing and deleting, evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def sessions(sessions_: DataFrame, messages: DataFrame, most: int | None = None) -> DataFrame:
    """Sessions with their last activity, latest first."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("_last"), F.count("*").alias("n_messages"))
    out = sessions_.join(last, "session_id", "left").select("session_id", F.coalesce("_last", "created_at").alias("last_activity"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"))
    ordered = out.orderBy(F.desc("last_activity"), "session_id")
    return ordered if most is None else ordered.limit(most)


def session_messages(messages: DataFrame, sessions_: DataFrame, user_id) -> DataFrame:
    """A user's messages in order of time, then of insertion."""
    own = sessions_.filter(F.col("user_id") == user_id).select("session_id")
    return messages.join(own, "session_id", "left_semi").withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "seq")))


def keep_recent(sessions_: DataFrame, most: int, by: str = "user_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("last_activity"), "session_id")
    return sessions_.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def append_message(messages: DataFrame, new: DataFrame, sessions_: DataFrame) -> DataFrame:
    """New messages (with user_id) go in if their session is the user's."""
    allowed = new.join(sessions_.select("session_id", "user_id"), ["session_id", "user_id"], "left_semi").drop("user_id")
    return messages.unionByName(allowed, allowMissingColumns=True)


def update_sessions(sessions_: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Values that a change gives; null leaves the old one. Only the owner's rows change."""
    new = changes.select("session_id", "user_id", *[F.col(c).alias(f"_{c}") for c in columns])
    both = sessions_.join(new, ["session_id", "user_id"], "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def content_hash(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", F.sha2(F.col(text_col).cast("binary"), 256))


def needs_ingest(incoming: DataFrame, indexed: DataFrame, key: str = "source") -> DataFrame:
    """Incoming documents whose content isn't indexed yet."""
    return content_hash(incoming).join(indexed.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def replace(existing: DataFrame, new: DataFrame, by: list[str], also: DataFrame | None = None) -> DataFrame:
    """``existing`` with all rows of each key in ``new`` (and in ``also``, for keys that are now empty) replaced."""
    gone = new.select(*by).distinct() if also is None else new.select(*by).union(also.select(*by)).distinct()
    return existing.join(gone, by, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row per key: new values where given, old ones else."""
    right = new.select(*by, *[F.col(c).alias(f"_{c}") for c in columns])
    return existing.join(right, by, "full_outer").select(*by, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted documents."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def document_list(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Each document with its number of chunks; none counts as 0."""
    n = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    return documents.join(n, key, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def list_totals(listed: DataFrame) -> DataFrame:
    return listed.agg(F.count("*").alias("n_documents"), F.sum("n_chunks").alias("n_chunks"), F.sum("size_bytes").alias("known_bytes"), F.count_if(F.col("size_bytes").isNull()).alias("n_unknown"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("source").alias("n_sources"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = text.word_count_tokens(F.col("text"))
    return chunks.select(n.alias("t")).agg(F.min("t").alias("least"), F.median("t").alias("median"), F.max("t").alias("most"))


class EmbeddingMismatchError(ValueError):
    """The vectors of a collection were made by another model."""


def assert_embedding_model(recorded: str | None, configured: str) -> None:
    if recorded and recorded != configured:
        raise EmbeddingMismatchError(f"indexed with {recorded}, asked with {configured}; index again")


# ---------------------------------------------------------------- evaluation runs


def summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, pass rate and mean similarity, over all or by category."""
    rate = F.round(F.avg(F.col("passed").cast("double")), 6)
    return results.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), rate.alias("pass_rate"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def weakest_first(by_category: DataFrame) -> DataFrame:
    return by_category.orderBy("pass_rate", "category")


def calibration(results: DataFrame, by: str) -> DataFrame:
    """Distribution of the similarity: count, ends, mean, median, 5th and 95th percentile."""
    p = lambda q: F.round(F.percentile("similarity", q), 6)
    return results.groupBy(by).agg(F.count("*").alias("n"), F.round(F.min("similarity"), 6).alias("least"), F.round(F.max("similarity"), 6).alias("most"), F.round(F.avg("similarity"), 6).alias("mean"), p(0.5).alias("median"), p(0.05).alias("p05"), p(0.95).alias("p95"))


def below_minimum(gold: DataFrame, least: int) -> DataFrame:
    return gold.groupBy("category").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= least)


# Which rule decides whether an answer of a category passes, where it isn't the plain one.
SCORING = {
    "edge": "behaviour", "out_of_scope": "refusal", "out_of_scope_partial": "refusal+exact", "consistency_pair": "self_similarity",
    "completeness": "similarity+completeness", "table_format": "similarity+table",
}


def scored(results: DataFrame, modes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Results with mode and passed. ``modes``: category, mode (a small table; no row: similarity+exact).

    ``results``: category, similarity, refused, exact (all expected values named), complete,
    table_ok, stable; a rule looks at those that its name lists.
    """
    named = results.join(modes.select("category", "mode"), "category", "left").withColumn("mode", F.coalesce("mode", F.lit("similarity+exact")))
    near = F.col("similarity") >= threshold
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = F.when(F.col("mode") == "behaviour", yes("stable") | yes("refused")).when(F.col("mode") == "refusal", yes("refused")).when(F.col("mode") == "refusal+exact", yes("refused") & yes("exact"))
    rules = rules.when(F.col("mode") == "self_similarity", yes("stable") & near).when(F.col("mode") == "similarity+completeness", near & yes("complete")).when(F.col("mode") == "similarity+table", near & yes("table_ok"))
    return named.withColumn("passed", rules.otherwise(near & yes("exact")))


def latest_runs(runs: DataFrame, by: str = "user_id") -> DataFrame:
    """The last run of each owner; run ids begin with their time, so the greatest is the last."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("run_id")))).filter("_n = 1").drop("_n")


def run_id(at: Column) -> Column:
    """A run's name from its time, as YYYYmmddTHHMMSSZ."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def newest_first(documents: DataFrame, by: str = "user_id") -> DataFrame:
    """Documents of each owner numbered from the newest, by name where times agree."""
    return documents.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), "filename")))


def owners(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """user_id, has_cells, has_documents, n_cells of everyone who owns something."""
    a = cells.groupBy("user_id").agg(F.count("*").alias("n_cells"))
    b = documents.select("user_id").distinct().withColumn("_d", F.lit(True))
    both = a.join(b, "user_id", "full_outer")
    return both.select("user_id", F.col("n_cells").isNotNull().alias("has_cells"), F.col("_d").isNotNull().alias("has_documents"), F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))


def ingest_summary(documents: DataFrame) -> DataFrame:
    """Totals of an ingest by mode: documents, chunks, stitched tables, cells, skipped."""
    return documents.groupBy("extraction_mode").agg(F.count("*").alias("n_documents"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_tables").alias("n_tables"), F.sum("n_cells").alias("n_cells"), F.count_if("skipped").alias("n_skipped"))


def sources_of(chunks: DataFrame, user: str = "user_id") -> DataFrame:
    """Every owner's sources once, blank names left out."""
    return chunks.filter(text.strip(F.coalesce("source", F.lit(""))) != "").select(user, "source").distinct()


def document_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """All chunks of the wanted documents (query_id, source) with their place in order of source and index."""
    own = chunks.join(wanted.select("query_id", "source").distinct(), "source")
    return own.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "chunk_index")))


def with_size(documents: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """Unknown sizes from the files' lengths (key, length), else null."""
    return documents.join(files.select(key, F.col("length").alias("_length")), key, "left").withColumn("size_bytes", F.coalesce("size_bytes", "_length")).drop("_length")


def delete_sessions(sessions_: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those of ``gone`` (session_id, user_id); only the owner's go."""
    own = sessions_.join(gone.select("session_id", "user_id"), ["session_id", "user_id"], "left_semi").select("session_id")
    return sessions_.join(own, "session_id", "left_anti"), messages.join(own, "session_id", "left_anti")


def newest_entries(cache: DataFrame, by: str, most: int = 400) -> DataFrame:
    """The newest ``most`` cached answers of each owner."""
    return cache.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("saved_at"), "entry_key"))).filter(F.col("_n") <= most).drop("_n")
