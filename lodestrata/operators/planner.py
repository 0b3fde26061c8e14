"""A workflow from retrieved sections: which sections there are, the strongest first, and stages made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def sections(units: DataFrame, order: str = "rank", preview: int = 220) -> DataFrame:
    """query_id, source, section, score, page, preview, n_units: the different sections of a question's units.

    ``units``: query_id, source, section, page, text, rerank (or null), fused and their order. The
    preview is that of the first unit.
    """
    score = F.coalesce(F.col("rerank").cast("double"), F.col("fused"))
    return units.groupBy("query_id", "source", F.coalesce("section", F.lit("")).alias("section")).agg(
        F.max(score).alias("score"), F.min("page").alias("page"), F.left(text.squeeze(F.min_by("text", order)), F.lit(preview)).alias("preview"), F.count("*").alias("n_units"), F.min(order).alias("_first")
    )


def ranked(sections_: DataFrame, most: int = 24) -> DataFrame:
    """The best ``most`` sections of a question with keys S1, S2 ..."""
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "_first", "source", "section")
    out = sections_.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= most)
    return out.withColumn("key", F.concat(F.lit("S"), F.col("position").cast("string"))).drop("_first")


def validated(ranked_: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stages with keys that exist (query_id, stage_no, title, purpose, keys), and sections of no stage (query_id, key).

    ``stages``: query_id, stage_no, title, purpose, keys, as a planner names them. Stages without a
    title go; questions with fewer than two sections, or without a stage, have no plan.
    """
    enough = ranked_.groupBy("query_id").agg(F.count("*").alias("_n"), F.collect_set("key").alias("_keys")).filter("_n >= 2").select("query_id", "_keys")
    good = stages.filter(text.strip(F.coalesce("title", F.lit(""))) != "").join(enough, "query_id")
    kept = good.select("query_id", "stage_no", text.strip(F.col("title")).alias("title"), text.strip(F.coalesce("purpose", F.lit(""))).alias("purpose"), F.filter("keys", lambda k: F.array_contains("_keys", k)).alias("keys"))
    used = kept.select("query_id", F.explode("keys").alias("key")).distinct()
    left = ranked_.join(kept.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "key").join(used, ["query_id", "key"], "left_anti")
    return kept, left


def rendered(stages: DataFrame, unassigned: DataFrame) -> DataFrame:
    """query_id, plan: the stages as lines, then what no stage uses."""
    refs = F.when(F.size("keys") > 0, F.array_join("keys", ", ")).otherwise("(no section assigned)")
    line = F.concat(F.lit("Stage "), F.col("_no").cast("string"), F.lit(": "), "title", F.when(F.col("purpose") != "", F.concat(F.lit(" -- "), "purpose")).otherwise(""), F.lit("\n    Use: "), refs)
    numbered = stages.withColumn("_no", F.row_number().over(Window.partitionBy("query_id").orderBy("stage_no")))
    body = numbered.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("_body"))
    by_number = F.transform(F.array_sort(F.collect_list(F.struct(F.length("key").alias("n"), "key"))), lambda x: x["key"])
    rest = unassigned.groupBy("query_id").agg(F.array_join(by_number, ", ").alias("_rest"))
    note = F.concat(F.lit("Sections not assigned to any stage (use only if genuinely relevant): "), "_rest")
    return body.join(rest, "query_id", "left").select("query_id", F.concat_ws("\n", "_body", F.when(F.col("_rest").isNotNull(), note)).alias("plan"))
