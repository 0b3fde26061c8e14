"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n of N rows and target share w is to be repeated w N / n times on average. Each
row's count is the inverse of the Poisson distribution with that mean at a number in [0, 1)
drawn by hashing seed and id, so a row's fate doesn't depend on partitioning or on a retry. The
row is exploded by its count and all copies are put in an order drawn by another hash: as that
number is uniform, its range is cut into equal parts that are dealt out and sorted, without a
pass that looks for bounds first. The means, a row for each source, are broadcast if they are
few enough; rows aren't dealt by source.

Defined cases: a null source is a source of its own; rows that agree in id draw the same number;
a null id draws as the empty text; sources without a weight get ``default_weight`` (0: they
go); a null text is carried along; texts of any length are moved once; columns of ``docs`` are
packed, so their names clash with nothing; a target for a source without rows is left out of the sum of weights; an empty table gives
an empty table. A mean over ``SPLIT`` is drawn as a sum of equal parts, which keeps exp(-mean)
away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, materialise

SPLIT = 200.0
SEED = "mix-1"


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_at(mean: Column, u: Column) -> Column:
    """The least k at which the Poisson distribution function with ``mean`` reaches more than ``u``.

    The terms go on to mean + 12 standard deviations + 40, beyond which less than 2^-52 is left.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).alias("k"))

    def step(s, k):
        term = s["term"] * mean / k
        return F.when(s["sum"] > u, s).otherwise(F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), k.cast("int").alias("k")))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def replication(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, default_weight: float = 0.0, source_col: str = "source") -> DataFrame:
    """Mean repetitions by source: source_col, n, mean.

    Without ``weights`` the target share of a source follows n ** temperature.
    """
    sizes = docs.groupBy(F.col(source_col).alias(source_col)).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    elif weights:
        listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(F.try_element_at(listed, F.col(source_col)), F.lit(float(default_weight)))
    else:
        weight = F.lit(float(default_weight))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()  # one row
    if not total["weights"]:
        return sizes.select(source_col, "n", F.lit(0.0).alias("mean"))
    mean = F.lit(total["rows"]) * F.col("weight") / F.lit(float(total["weights"])) / F.col("n")
    return sizes.select(source_col, "n", F.round(mean, 12).alias("mean"))


def _in_order(placed: DataFrame, parts: int) -> DataFrame:
    """All rows by ``_place``, whose values are uniform in [0, 1)."""
    part = F.floor(F.col("_place") * parts).cast("int")
    return placed.withColumn("_part", part).repartitionById(parts, "_part").sortWithinPartitions("_place", "_id", "_copy")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, default_weight: float = 0.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True) -> DataFrame:
    """The rows of ``docs`` as structs ``_row``, as often as drawn, with ``_copy`` (from 1) and ``_place`` in [0, 1).

    Rows come in the order of ``_place``: a shuffle of all copies to ``spark.sql.shuffle.partitions`` ranges.
    """
    means = replication(docs, weights, temperature, default_weight, source_col).select(F.col(source_col).alias("_source"), F.col("mean").alias("_mean"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_of"))
    both = beside(packed, materialise(means, "means"), F.col("_of").eqNullSafe(F.col("_source")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_mean") / SPLIT)).cast("int")
    one = poisson_at(F.col("_mean"), unit(seed, F.col("_id"), F.lit(1)))
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda s, j: s + poisson_at(F.col("_mean") / parts, unit(seed, F.col("_id"), j)))
    count = F.when(F.col("_mean") <= 0, 0).when(parts == 1, one).otherwise(many)
    drawn = both.withColumn("_count", count).filter("_count > 0")
    copies = drawn.select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("_copy"))
    placed = copies.withColumn("_place", unit(seed + ":place", F.col("_id"), F.col("_copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (_in_order(placed, parts) if shuffle else placed).select("_row", "_copy", "_place")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """As ``mix``, with the columns of ``docs`` only."""
    return mix(docs, **options).select("_row.*")
