"""Ranking: BM25, exact nearest neighbours, fusion, routing, caps and orders.

Every operator takes a ``query_id`` beside its rows, so one call serves one question or many.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import blocks

K1, B, EPSILON = 1.5, 0.75, 0.25


def term_counts(chunks: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, term, tf; and dl, the chunk's number of tokens."""
    tokens = chunks.select(key, text.bm25_tokens(F.col(text_col)).alias("_t"))
    return tokens.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n chunks and their mean length. Reads no more than token counts."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(text.bm25_tokens(F.col(text_col)))).alias("avgdl"))


def term_stats(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf: a term that most chunks hold gets a share of the mean idf."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("_one", F.lit(1)).join(stats.select(F.lit(1).alias("_one"), "n"), "_one").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean")).select(F.lit(1).alias("_one"), "mean")
    return raw.join(mean, "_one").select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(chunks: DataFrame, queries: DataFrame, key: str, k: int, text_col: str = "text") -> DataFrame:
    """query_id, key, score, rank of the best ``k`` chunks with a score over 0."""
    return top(bm25_scores(chunks, queries, key, text_col), ["query_id"], [F.desc("score"), key], k)


def bm25_scores(chunks: DataFrame, queries: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """query_id, key, score of all chunks with a score over 0, unranked.

    ``queries``: query_id, text. Terms that a question repeats count again. Corpus counts come
    from all chunks; only terms that are asked for are scored.
    """
    counts = term_counts(chunks, key, text_col)
    stats = corpus_stats(chunks, text_col)
    asked = queries.select("query_id", F.explode(text.bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = term_stats(counts, stats)
    hits = counts.join(asked, "term").join(idf.select("term", "idf"), "term").withColumn("_one", F.lit(1)).join(stats.select(F.lit(1).alias("_one"), "avgdl"), "_one")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", key).agg(F.round(F.sum(F.col("qtf") * gain), 6).alias("score")).filter("score > 0")


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. Each task drops the rest before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


#: Bytes of query vectors that may be sent to every task.
MOST_QUERY_BYTES = 256 << 20


def _checked(queries: DataFrame, numbers_in: Column) -> None:
    """A stated set of ``queries`` goes to every task: its size is checked first."""
    n, size = queries.agg(F.count("*"), F.sum(numbers_in)).first()
    if (size or 0) * 8 > MOST_QUERY_BYTES:
        raise ValueError(f"{n} query vectors are too many to send out at once; ask in parts")


def _against(rows: DataFrame, queries: DataFrame, numbers_in: Column) -> DataFrame:
    """Each of ``rows`` beside each of a stated set of ``queries`` (as q)."""
    _checked(queries, numbers_in)
    listed = queries.agg(F.collect_list(F.struct(*queries.columns)).alias("_queries")).select(F.lit(1).alias("_one"), "_queries")
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").select(*rows.columns, F.explode("_queries").alias("q"))


def _best_of_each(rows: DataFrame, asked: pa.Table, key: str, k: int, by, name: str) -> DataFrame:
    """query_id, key and a value: for each of ``asked`` (query_id, then what asks) the ``k`` best rows of every task."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(asked)
    schema = f"_q long, `{name}` double, `{key}` {rows.schema[key].dataType.simpleString()}"

    def run(batches):
        for q, value, keys in by(sent.value.column(1).combine_chunks(), key, k, batches):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(value), keys], names=["_q", name, key])

    return blocks.dealt(rows, key).mapInArrow(run, schema)


def _named(found: DataFrame, ids: list, kind: str) -> DataFrame:
    """``found`` with the query_id of each question's number (_q)."""
    names = found.sparkSession.createDataFrame(list(enumerate(ids)), f"_q long, query_id {kind}")
    return found.join(F.broadcast(names), "_q").drop("_q")


def max_sim(items: DataFrame, queries: DataFrame, key: str, k: int, parts_col: str = "parts") -> DataFrame:
    """query_id, key, score, rank by late interaction: every part of a question finds its best part of an item.

    ``queries``: query_id and parts, a stated set that is checked to be small.
    """
    asked = queries.select("query_id", F.col(parts_col).cast("array<array<double>>").alias("parts")).filter("parts IS NOT NULL")
    _checked(asked, F.size(F.flatten("parts")))
    listed = asked.toArrow()
    rows = items.select(key, F.col(parts_col).alias("_p")).filter("_p IS NOT NULL")
    found = _named(_best_of_each(rows, listed, key, k, blocks.by_parts, "_v"), listed.column(0).to_pylist(), queries.schema["query_id"].dataType.simpleString())
    scored = found.select("query_id", key, F.when(F.col("_v") < blocks.NONE, -F.col("_v") + 0.0).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), key], k)


def knn(vectors: DataFrame, queries: DataFrame, key: str, k: int, vector_col: str = "embedding") -> DataFrame:
    """query_id, key, distance, rank: the exact ``k`` nearest by cosine distance.

    ``queries``: query_id, vector; a stated set that is checked to be small, then held by every
    task, against all vectors in blocks. Each task keeps ``k`` rows of a query before anything
    is shuffled.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    _checked(asked, F.size("vector"))
    listed = asked.toArrow()
    rows = vectors.select(key, F.col(vector_col).alias("_v"))
    found = _named(_best_of_each(rows, listed, key, k, blocks.by_cosine, "_d"), listed.column(0).to_pylist(), queries.schema["query_id"].dataType.simpleString())
    scored = found.select("query_id", key, F.when(F.col("_d") < blocks.NAN, F.col("_d")).otherwise(F.lit(float("nan"))).alias("distance"))
    return top(scored, ["query_id"], ["distance", key], k)


def fuse(lists: DataFrame, key: str, k: int = 60) -> DataFrame:
    """query_id, key, fused and the best rank in each list, from (query_id, list, key, rank)."""
    return lists.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("fused"), F.min(F.when(F.col("list") == "dense", F.col("rank"))).alias("dense_rank"), F.min(F.when(F.col("list") == "keyword", F.col("rank"))).alias("keyword_rank"))


def score_documents(hits: DataFrame, key: str, source: str = "source", top_chunks: int = 3) -> DataFrame:
    """query_id, source, score (sum of its best chunks), hits."""
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", source).orderBy(F.desc("fused"), key)))
    return ranked.groupBy("query_id", source).agg(F.round(F.sum(F.when(F.col("_r") <= top_chunks, F.col("fused"))), 9).alias("score"), F.count("*").alias("hits"))


def gate(scores: DataFrame, ratio: float = 0.45, most: int = 2, source: str = "source") -> DataFrame:
    """The leading document and those with at least ``ratio`` of its score, ``most`` at most."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), source)
    ranked = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.withColumn("_top", F.max("score").over(Window.partitionBy("query_id"))).filter((F.col("rank") == 1) | (F.col("score") >= ratio * F.col("_top"))).drop("_top")


def cap(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """At most ``k`` rows of each group, in the given order."""
    return top(df, by, order, k, "_nth").drop("_nth")


def round_robin(lists: DataFrame, key: str, depth: int) -> DataFrame:
    """One of each entity in turn down to ``depth``; of repeats only the first. Input: query_id, entity_no, rank, key."""
    taken = lists.filter(F.col("rank") <= depth)
    first = taken.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank", "entity_no"))).filter("_r = 1").drop("_r")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "entity_no")))


def reserve(candidates: DataFrame, chosen: DataFrame, key: str, slots: int = 3, source: str = "source") -> DataFrame:
    """The best candidates from documents that weren't chosen."""
    return top(candidates.join(chosen.select("query_id", source), ["query_id", source], "left_anti"), ["query_id"], [F.desc("fused"), key], slots)


def interleave(df: DataFrame, rank: str = "rank", by: str = "query_id") -> DataFrame:
    """Odd ranks going up, then even ones coming down, so the best stand at both ends (from three rows on)."""
    n = F.count("*").over(Window.partitionBy(by))
    odd = F.col(rank) % 2 == 1
    order = F.when(n <= 2, F.col(rank)).otherwise(F.when(odd, F.col(rank)).otherwise(F.lit(1 << 30) - F.col(rank)))
    return df.withColumn("_o", order).withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("_o"))).drop("_o")


def sweep(chunks: DataFrame, routed: DataFrame, keyword_scores: DataFrame, key: str, most: int = 60, source: str = "source") -> DataFrame:
    """All chunks of the routed documents in order; beyond ``most``, the best by keyword, marked as truncated.

    ``keyword_scores``: query_id, key, score. Only chunks of routed documents are ranked, and each
    task keeps no more than ``most`` of them for a question.
    """
    pool = chunks.join(routed.select("query_id", source), source)
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("_n"))
    ranked = pool.join(keyword_scores.select("query_id", key, F.col("score").alias("_k")), ["query_id", key], "left")
    best = top(ranked, ["query_id"], [F.col("_k").desc_nulls_last(), key], most, "_nth").join(sizes, "query_id")
    return best.filter((F.col("_n") <= most) | F.col("_k").isNotNull()).select("query_id", source, key, (F.col("_n") > most).alias("truncated"))


def rerank_window(fused: DataFrame, key: str, final_k: int, by: str = "query_id") -> DataFrame:
    """How many fused rows are worth reranking: four times the final number, ten more at least."""
    return top(fused, [by], [F.desc("fused"), key], max(4 * final_k, final_k + 10))


def survivors(df: DataFrame, least: int, final_k: int, key: str) -> DataFrame:
    """Rows without a rerank score or with enough of it; the best ``final_k`` by rerank, then fusion."""
    return top(df.filter(F.col("rerank").isNull() | (F.col("rerank") >= least)), ["query_id"], [F.col("rerank").desc_nulls_last(), F.desc("fused"), key], final_k)


def router_factor(score: Column, weight: float = 0.35) -> Column:
    return 1 + weight * (2 * score - 1)


def refine_documents(scores: DataFrame, signals: list[str], weight: float = 0.35, protect: float = 0.85) -> DataFrame:
    """Scores moved by the mean of the signals within bounds; leaders before aren't moved down."""
    mean = sum((F.col(s) for s in signals[1:]), F.col(signals[0])) / len(signals)
    best = F.max("score").over(Window.partitionBy("query_id"))
    moved = F.col("score") * router_factor(mean, weight)
    return scores.withColumn("refined", F.round(F.when(F.col("score") >= protect * best, F.greatest("score", moved)).otherwise(moved), 9))
