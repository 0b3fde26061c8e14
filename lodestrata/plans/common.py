"""Loading tables and registering queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..operators.postings import Counted, Postings
from ..operators.vectors import VectorIndex
from ..sources.shared import shared_root, state_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries of a module: ``@add(sql)`` above a function (spark, sf_dir) -> DataFrame."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return keep


def _index_root(spark: SparkSession, table_: DataFrame, kind: str) -> str:
    """A folder of this application's for an index of the table as its files are now."""
    return f"{shared_root(spark)}/{kind}-{hashlib.sha256(state_of(table_).encode()).hexdigest()[:24]}"


def postings_of(spark: SparkSession, sf_dir: str) -> Postings:
    """The inverted index of ``documents``: written by the first question to the table, read by the later ones."""
    docs = table(spark, sf_dir, "documents")
    index = Postings(spark, _index_root(spark, docs, "postings"), "doc_id", "doc_id")
    return index if index.exists() else index.build(docs)


def counted_of(spark: SparkSession, sf_dir: str) -> Counted:
    """The counted terms of ``documents``, for batches of many questions: written once likewise."""
    docs = table(spark, sf_dir, "documents")
    counted = Counted(spark, _index_root(spark, docs, "counted"), "doc_id", "doc_id")
    return counted if counted.exists() else counted.build(docs)


def vectors_of(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The cells of ``embeddings``, written once likewise."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, _index_root(spark, vectors, "vectors"), "vec_id")
    return index if index.exists() else index.build(vectors)
