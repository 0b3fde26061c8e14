"""Quality rules: fixed limits, then robust multivariate outliers, in DataFrame functions only.

Each text gets word and line counts (see ``text_stats``). Documents that pass the fixed limits
have a vector of three statistics that vary in all ordinary prose: mean word length, marks to a
word, and how many of the words are distinct. It is held against the document's group of one
language and source: the group's centre and covariance come from the minimum covariance
determinant (concentration steps over the half of the group that lies closest), and a document
goes if its Mahalanobis distance from that centre is beyond a chi-square limit. Equal vectors
count once in an estimate, so copies of a text, however many, are not what a group is like.
Statistics of few words scatter more; they are drawn towards the group's median as if ``FEW``
words of that kind stood beside them.

The concentration steps never bring a group together: a step counts vectors by group and by
bin of distance, with the sums that mean and covariance need, and adds up the bins of each
group from the centre outwards until they hold ``share`` of it, the last bin in part. A group is
done when a step doesn't lower the determinant of its covariance any more (``STILL`` of its
logarithm), and keeps the least; steps go on with the other groups until all are done. A group with few distinct vectors takes the estimates of its language, a
language with few those of all, and a corpus with few isn't judged by distance.

Defined cases: a null text has no words and fails; very long texts are counted whole; null
language and source are groups of their own; a variance below ``SINGULAR`` of the corpus's is
raised to it, so that every covariance can be inverted; rows that agree in id are judged one by
one; where too few distinct vectors exist the distance is null and the document is kept; other
columns, whatever their names, aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, beside, digest, drop_rows, is_empty, let, materialise, text_or_empty

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "#*$%&|<>"
#: The vector of a document, and how many words its group's medians count for in it.
FEATURES = ["f_word", "f_mark", "f_distinct"]
FEW = 50
#: Share of a statistic's variance over all distinct vectors that a group's is at least.
SINGULAR = 1e-6
SHARE, LEAST, STILL = 0.5, 60, 1e-4
#: Chi-square with 3 degrees of freedom: 0.9999 quantile. The covariance of the closest SHARE of a
#: normal sample is too small by the factor P(chi2_5 <= q) / SHARE, q the SHARE quantile of chi2_3.
LIMIT, SHRINKAGE = 21.11, 0.2035 / 0.5
#: Bins of log distance: 16 to a doubling, from 2^-20 to 2^40.
BINS, LOW = 16, -20


def _array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(hashes: Column) -> Column:
    """How many words lie in 8-word windows that occur twice or more; ``hashes``: of the words."""

    def paired(apart: int):
        return lambda h: F.when(
            F.size(h) > apart,
            F.transform(F.slice(h, F.lit(1), F.size(h) - apart), lambda x, i: F.xxhash64(x, F.get(h, i + apart))),
        ).otherwise(F.slice(h, F.lit(1), F.lit(0)))

    def covered(w: Column) -> Column:
        """Places of windows that have an equal elsewhere, in order, then words under them."""
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            placed,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, i: F.struct(
                                x["i"].alias("i"),
                                (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places,
            start,
            lambda s, i: F.struct((s["n"] + (i + WINDOW) - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")),
            lambda s: s["n"],
        )

    windows = let(let(let(hashes, paired(1)), paired(2)), paired(4))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks and n_distinct of each text, beside the columns ``keep``.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at \\n and count if they hold a word, marks are
    neither white space nor letters nor digits, and distinct words are told apart by a hash.
    """
    texts = docs.select(*keep, text_or_empty(text_col).alias("_text"))
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    # the words are counted and hashed in one go; long texts would double in memory otherwise
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _array_sum(F.transform(w, lambda x: F.length(x).cast("long"))).alias("word_chars"),
            let(
                F.transform(w, lambda x: F.xxhash64(x)),
                lambda h: F.struct(F.size(F.array_distinct(h)).cast("long").alias("n_distinct"), F.when(F.size(h) > WINDOW, _repeated(h)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words")),
            ).alias("h"),
        ),
    )
    lines = let(
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    symbols = (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long")
    marks = F.length(F.regexp_replace("_text", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).cast("long")
    out = texts.select(*keep, counted.alias("_w"), symbols.alias("n_symbols"), lines.alias("_l"), marks.alias("n_marks"))
    return out.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.h.n_repeat_words", "_l.n_lines", "n_marks", "_w.h.n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Logarithm of the mean word length, root of the marks to a word, and the power of the number of words that are distinct."""
    words = F.greatest("n_words", F.lit(1))
    return {
        "f_word": F.log1p(F.col("word_chars") / words),
        "f_mark": F.sqrt(F.col("n_marks") / words),
        "f_distinct": F.log(F.greatest("n_distinct", F.lit(1))) / F.log(F.greatest("n_words", F.lit(2))),
    }


# ---------------------------------------------------------------- minimum covariance determinant


def _pairs() -> list[tuple[str, str]]:
    names = list(FEATURES)
    return [(a, b) for k, a in enumerate(names) for b in names[: k + 1]]


def _with_factor(cov: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Adds the lower Cholesky factor l_<a>_<b> of the covariance c_<a>_<b>, one column of it at a time."""
    names = list(FEATURES)
    for k, b in enumerate(names):
        own = F.col(f"c_{b}_{b}") - sum((F.col(f"l_{b}_{c}") * F.col(f"l_{b}_{c}") for c in names[:k]), F.lit(0.0))
        cov = cov.withColumn(f"l_{b}_{b}", F.sqrt(F.greatest(own, F.lit(floors[b]))))
        for a in names[k + 1 :]:
            rest = F.col(f"c_{a}_{b}") - sum((F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}") for c in names[:k]), F.lit(0.0))
            cov = cov.withColumn(f"l_{a}_{b}", rest / F.col(f"l_{b}_{b}"))
    return cov


def _distance(df: DataFrame, alias: str = "d2") -> DataFrame:
    """Adds the squared Mahalanobis distance by forward substitution in the group's factor."""
    names = list(FEATURES)
    for k, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{a}") - sum((F.col(f"l_{a}_{b}") * F.col(f"_y_{b}") for b in names[:k]), F.lit(0.0))
        df = df.withColumn(f"_y_{a}", rest / F.col(f"l_{a}_{a}"))
    return df.withColumn(alias, sum((F.col(f"_y_{a}") * F.col(f"_y_{a}") for a in names), F.lit(0.0))).drop(*[f"_y_{a}" for a in names])


def _estimates(sums: DataFrame, floors: dict[str, float], shrinkage: float) -> DataFrame:
    """Mean and covariance of each group from n, s_<a>, s_<a>_<b>; variances are no less than their floors."""

    def covariance(a: str, b: str) -> Column:
        own = (F.col(f"s_{a}_{b}") / F.col("n") - F.col(f"s_{a}") / F.col("n") * F.col(f"s_{b}") / F.col("n")) / shrinkage
        return F.greatest(own, F.lit(floors[a])) if a == b else own

    out = sums.select("_group", *[(F.col(f"s_{a}") / F.col("n")).alias(f"m_{a}") for a in FEATURES], *[covariance(a, b).alias(f"c_{a}_{b}") for a, b in _pairs()])
    return _with_factor(out, floors)


def _sums():
    return [F.count("*").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in FEATURES], *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _pairs()]]


def _spread(vectors: DataFrame) -> dict[str, float]:
    """The variance of each statistic over all distinct vectors."""
    row = vectors.agg(*[F.var_pop(a).alias(a) for a in FEATURES]).first()
    return {a: row[a] or 1e-6 for a in FEATURES}


def _medians(rows: DataFrame, spread: dict[str, float], floors: dict[str, float]) -> DataFrame:
    """The start: medians, also as o_<a>, and variances from the 16 and 84 percent quantiles, or the corpus's where these are equal."""
    mid = rows.groupBy("_group").agg(*[F.percentile_approx(a, F.array(F.lit(0.1587), F.lit(0.5), F.lit(0.8413)), 2000).alias(a) for a in FEATURES])

    def variance(a: str) -> Column:
        own = F.pow((F.col(a)[2] - F.col(a)[0]) / 2, F.lit(2.0))
        return F.when(own > floors[a], own).otherwise(spread[a])

    return _with_factor(
        mid.select(
            "_group",
            *[F.col(a)[1].alias(f"{x}_{a}") for x in "mo" for a in FEATURES],
            *[(variance(a) if a == b else F.lit(0.0)).alias(f"c_{a}_{b}") for a, b in _pairs()],
        ),
        floors,
    )


def _with_model(rows: DataFrame, now: DataFrame) -> DataFrame:
    """``rows`` with the estimates of their group; groups are few beside rows, and no group meets in one task."""
    return beside(rows, now.withColumnRenamed("_group", "_of"), F.col("_group") == F.col("_of")).drop("_of")


def _drawn(rows: DataFrame) -> DataFrame:
    """Statistics drawn towards the medians o_<a> of their group, the more the fewer words they come from."""
    weight = F.col("n_words") / (F.col("n_words") + FEW)
    return rows.withColumns({a: F.col(f"o_{a}") + weight * (F.col(a) - F.col(f"o_{a}")) for a in FEATURES})


def _log_det() -> Column:
    return sum((F.log(f"l_{a}_{a}") for a in FEATURES), F.lit(0.0)) * 2


def _concentrate(scratch: Scratch, rows: DataFrame, now: DataFrame, floors: dict[str, float], share: float) -> DataFrame:
    """One step: estimates from the ``share`` of each group that is closest under the present ones.

    What is brought together is a row of sums for each group and bin of distance, however large
    the group.
    """
    near = _distance(_with_model(rows, now)).withColumn("_bin", F.floor(F.log2(F.greatest("d2", F.lit(2.0**LOW))) * BINS).cast("int"))
    # written out, so that the sums of a bin meet by group and bin, and only a row for each bin meets by group
    bins = scratch.table(near.groupBy("_group", "_bin").agg(*_sums()), "bins")
    outwards = Window.partitionBy("_group").orderBy("_bin")
    whole = Window.partitionBy("_group")
    names = ["n", *[f"s_{a}" for a in FEATURES], *[f"s_{a}_{b}" for a, b in _pairs()]]
    run = bins.select("_group", "_bin", F.sum("n").over(whole).alias("_all"), *[F.col(c).alias(f"_of_{c}") for c in names], *[F.sum(c).over(outwards).alias(c) for c in names])
    first = run.filter(F.col("n") >= share * F.col("_all")).withColumn("_k", F.row_number().over(outwards)).filter("_k = 1")
    beyond = (F.col("n") - share * F.col("_all")) / F.col("_of_n")  # the part of the last bin that isn't needed
    inner = first.select("_group", *[(F.col(c) - beyond * F.col(f"_of_{c}")).alias(c) for c in names])
    out = scratch.table(_estimates(inner, floors, SHRINKAGE).withColumn("_det", _log_det()), "step")
    scratch.drop(bins)
    return out


def group_models(stats: DataFrame, share: float = SHARE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The rows of ``stats`` with their group (null: too few vectors for any), and the estimates of each group."""
    vectors = materialise(stats.select("lang", "source", "n_words", *FEATURES).distinct(), "vectors")
    sizes = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    of_lang, of_all = F.sum("n").over(Window.partitionBy("lang")), F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the groups, which are few
    level = F.when(F.col("n") >= least, 2).when(of_lang >= least, 1).when(of_all >= least, 0)
    levels = materialise(sizes.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), level.alias("_level")), "levels")
    name = lambda lang, source: F.to_json(F.struct(lang.alias("l"), source.alias("s")))
    own = {2: name(F.col("lang"), F.col("source")), 1: name(F.col("lang"), F.lit("*")), 0: F.lit("*")}

    def with_level(rows: DataFrame) -> DataFrame:
        return beside(rows, levels, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")

    chosen = with_level(stats).withColumn("_group", F.when(F.col("_level") == 2, own[2]).when(F.col("_level") == 1, own[1]).when(F.col("_level") == 0, own[0]))
    # a vector counts in its own group, and in those of its language and of all that small groups turn to
    needed = levels.agg(F.min("_level").alias("m")).first()["m"]
    groups = [F.when(F.col("_level") == 2, own[2])] + ([own[1]] if needed is not None and needed < 2 else []) + ([own[0]] if needed == 0 else [])
    rows = with_level(vectors).select(F.explode(F.array_compact(F.array(*groups))).alias("_group"), "n_words", *FEATURES)
    spread = _spread(vectors)
    floors = {a: SINGULAR * v for a, v in spread.items()}
    scratch = Scratch(stats.sparkSession)
    start = scratch.table(_medians(rows, spread, floors), "start")
    drawn = scratch.table(_drawn(_with_model(rows, start.select("_group", *[f"o_{a}" for a in FEATURES]))).select("_group", *FEATURES), "drawn")
    steps, moving = [], start
    while True:
        steps.append(_concentrate(scratch, drawn, moving, floors, share))
        moving = steps[-1]
        if len(steps) > 1:  # the start is no estimate of this kind
            before = steps[-2].select(F.col("_group").alias("_of"), F.col("_det").alias("_was"))
            moving = moving.join(before, F.col("_group") == F.col("_of")).filter(F.col("_det") < F.col("_was") - STILL).select(*steps[-1].columns)
        if is_empty(moving):
            break
    best = reduce(DataFrame.unionByName, steps).groupBy("_group").agg(F.min_by(F.struct(*[c for c in steps[0].columns if c != "_group"]), "_det").alias("_m")).select("_group", "_m.*").drop("_det")
    medians = start.select(F.col("_group").alias("_of"), *[f"o_{a}" for a in FEATURES])
    models = materialise(best.join(medians, F.col("_group") == F.col("_of")).drop("_of"), "models")
    scratch.clear()
    return chosen, models


def scored(chosen: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of a group with their squared distance d2 from its centre."""
    return _distance(_drawn(_with_model(chosen, models)))


def judged(docs: DataFrame, id_col: str = "doc_id", limit: float = LIMIT) -> DataFrame:
    """One row per row of ``docs``: id_col, the statistics, base_failed, distance (null: not judged by it), kept, and the text's digest."""
    stats = text_stats(docs.withColumn("_digest", digest()), [id_col, "lang", "source", "_digest"])
    stats = materialise(stats.withColumn("base_failed", base_failed()).withColumns(features()), "stats")
    chosen, models = group_models(stats.filter(~F.col("base_failed")))
    columns = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = scored(chosen, models).select(*columns, F.col("d2").alias("distance"), (F.col("d2") <= limit).alias("kept"), "_digest")
    none = F.lit(None).cast("double").alias("distance")
    few = chosen.filter("_group IS NULL").select(*columns, none, F.lit(True).alias("kept"), "_digest")
    bad = stats.filter("base_failed").select(*columns, none, F.lit(False).alias("kept"), "_digest")
    return good.unionByName(few).unionByName(bad)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; rows that agree in id and text share their fate but for a difference in language or source."""
    rows = judged(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias("_id"), "_digest").agg(F.count("*").alias("_copies"), F.count_if("kept").alias("_stay"))
    return drop_rows(docs, rows.filter("_copies > _stay"), id_col)
