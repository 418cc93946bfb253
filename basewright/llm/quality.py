"""Quality rules: simple text statistics, then robust multivariate outliers.

The statistics of a document become a transformed vector. Per language and
source the minimum-covariance-determinant estimate gives a centre and a shape
that outliers don't pull. Concentration steps (estimate from the nearest share,
measure all again) run from three starts: medians with median deviations,
medians with the least spreads, mean and covariance of all rows. After
``FIRST_STEPS`` each group goes on with the start of the least determinant,
until no group's determinant falls any more. Documents far from the centre by Mahalanobis distance are rejected. Everything
is DataFrame expressions; the rows of a group are only ever aggregated.

Edge cases: null or blank text has no words and fails the base rule; null
language or source is a group of its own; sources with few documents are
pooled by language, and few of a language all together; vectors that agree in
a coordinate meet a stated least spread; an empty table gives an empty result;
rows that repeat count as often as they occur; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.llm.common import let, small, stored, table, words_between

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: A group needs so many rows to have an estimate of its own.
MIN_GROUP = 200
#: Share of a group that a concentration step keeps, the steps from each start, and a bound on those that follow.
CORE, FIRST_STEPS, MORE_STEPS = 0.75, 2, 20
#: Least standard deviation of each coordinate, in units of the vector. Where a group has
#: no more, 40 % repeated lines or 33 % repeated words alone reach the cutoff.
SPREAD = (0.5, 0.1, 0.08, 0.1, 0.09)
#: Share of the covariances that is kept, so that coordinates that move together have an inverse.
JOINT = 0.99
#: Medians of the chi-square law by degrees of freedom (fixed values).
CHI2_MEDIAN = {1: 0.4549, 2: 1.3863, 3: 2.3660, 4: 3.3567, 5: 4.3515}
#: Squared distance beyond which a document is rejected. The normal law would
#: leave less than one in 10^10 there; real statistics have longer tails.
CUTOFF = 40.0
#: Vectors are kept as whole multiples of 1 / SCALE, so that sums are exact.
SCALE = 1000
DIMS = len(SPREAD)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows whose 64-bit digest occurs twice in the row."""

    def covered(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return let(pairs, lambda s: F.aggregate(starts(s), zero, step)["n"])

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(some)

    return let(words, of)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = words_between(F.col(text), WORD_GAP)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    return df.withColumns({"_lines": line_counts, "_words": word_counts}).withColumns(
        {
            "n_words": F.col("_words.n").cast("long"),
            "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_lines": F.col("_lines.n").cast("long"),
            "n_dup_lines": F.col("_lines.dup").cast("long"),
            "n_repeat_words": F.col("_words.repeat").cast("long"),
        }
    ).drop("_lines", "_words")


def _vector() -> list[Column]:
    """The transformed statistics: log sizes, square roots of shares."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    raw = [
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]
    return [F.round(c * SCALE).cast("long") for c in raw]


def _quantile(rows: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """Per group the least ``value`` (an integer) that ``share`` of the rows don't exceed.

    Counts per value are aggregated first; values take few thousand levels.
    """
    counts = rows.groupBy(*by, value).count()
    w = Window.partitionBy(*by)
    upto = F.sum("count").over(w.orderBy(value))
    return counts.select(*by, value, upto.alias("_upto"), F.sum("count").over(w).alias("_all")).where(F.col("_upto") >= share * F.col("_all")).groupBy(*by).agg(F.min(value).alias(name))


def _level(distance: Column) -> Column:
    """A squared distance as one of some thousand levels, fine in proportion."""
    return F.round(F.log1p(distance) * 200).cast("long")


def _inverse(rows: DataFrame) -> DataFrame:
    """Replace the covariance columns s_i_j by those of its inverse, p_i_j (Gauss-Jordan), and ``det``, the product of the pivots."""
    n = range(DIMS)
    a = {(i, j): F.col(f"s_{min(i, j)}_{max(i, j)}") for i in n for j in n}
    b = {(i, j): F.lit(1.0 if i == j else 0.0) for i in n for j in n}
    rows = rows.withColumn("det", F.lit(1.0)).withColumns({f"_a0_{i}_{j}": a[i, j] for i in n for j in n} | {f"_b0_{i}_{j}": b[i, j] for i in n for j in n})
    for k in n:
        col = lambda m, i, j, k=k: F.col(f"_{m}{k}_{i}_{j}")
        new = {}
        for m in "ab":
            for j in n:
                top = col(m, k, j) / col("a", k, k)
                for i in n:
                    new[f"_{m}{k + 1}_{i}_{j}"] = top if i == k else col(m, i, j) - col("a", i, k) * col(m, k, j) / col("a", k, k)
        rows = rows.select(*[c for c in rows.columns if not c.startswith(("_a", "_b")) and c != "det"], (F.col("det") * col("a", k, k)).alias("det"), *[v.alias(c) for c, v in new.items()])
    keep = [c for c in rows.columns if not c.startswith(("_a", "_b", "s_"))]
    return rows.select(*keep, *[F.col(f"_b{DIMS}_{i}_{j}").alias(f"p_{i}_{j}") for i in n for j in n if i <= j])


def _distance() -> Column:
    diff = [F.col(f"x_{i}") / SCALE - F.col(f"m_{i}") for i in range(DIMS)]
    return sum(((2 if i < j else 1) * F.col(f"p_{i}_{j}") * diff[i] * diff[j] for i in range(DIMS) for j in range(i, DIMS)), F.lit(0.0))


def _diagonal(rows: DataFrame, scales: list[Column]) -> DataFrame:
    return rows.withColumns({f"p_{i}_{j}": 1 / (scales[i] * scales[i]) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(i, DIMS)})


def _estimate(core: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: centre, inverse of the floored covariance and its determinant."""
    dims = range(DIMS)
    x = [F.col(f"x_{i}").cast("double") for i in dims]
    sums = core.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(x[i]).alias(f"t_{i}") for i in dims], *[F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i in dims for j in dims if i <= j])
    unit = float(SCALE * SCALE)
    cov = lambda i, j: (F.col(f"q_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("n")) / F.col("n") / unit
    shape = lambda i, j: F.greatest(cov(i, j), F.lit(SPREAD[i] ** 2)) if i == j else JOINT * cov(i, j)
    return _inverse(sums.select(*keys, *[(F.col(f"t_{i}") / F.col("n") / SCALE).alias(f"m_{i}") for i in dims], *[shape(i, j).alias(f"s_{i}_{j}") for i in dims for j in dims if i <= j]))


def _concentrated(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """The estimates from the ``CORE`` share of rows that is nearest to a stored model, by its keys."""
    measured = rows.join(small(model), keys[0]).select(*keys, *[f"x_{i}" for i in range(DIMS)], _level(_distance()).alias("level"))
    edge = stored(_quantile(measured, keys, "level", CORE, "edge"), "edge")
    return _estimate(measured.join(small(edge), keys).where("level <= edge"), keys)


def covariance_determinant(rows: DataFrame, group: str = "grp") -> DataFrame:
    """Per group: centre m_i, inverse shape p_i_j, its determinant det and ``factor``, from rows with x_0 … (a stored table).

    ``factor`` makes the median squared distance that of the normal law.
    """
    dims, keys = range(DIMS), [group, "start"]
    long = rows.select(group, F.posexplode(F.array(*[F.col(f"x_{i}") for i in dims])).alias("dim", "x"))
    mid = stored(_quantile(long, [group, "dim"], "x", 0.5, "mid"), "mid")
    off = long.join(small(mid), [group, "dim"]).withColumn("off", F.abs(F.col("x") - F.col("mid")))
    mad = _quantile(off, [group, "dim"], "off", 0.5, "mad")
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c))) / SCALE
    first = mid.join(mad, [group, "dim"]).groupBy(group).agg(*[pick("mid", i).alias(f"m_{i}") for i in dims], *[pick("mad", i).alias(f"d_{i}") for i in dims])
    first = first.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    first = _diagonal(first, [F.when(F.col("start") == 0, F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(SPREAD[i]))).otherwise(F.lit(SPREAD[i])) for i in dims]).withColumn("det", F.lit(0.0))
    whole = _estimate(rows.withColumn("start", F.lit(2)), keys)
    model = stored(whole.unionByName(first.select(*whole.columns)), "starts")
    for _ in range(FIRST_STEPS):
        model = stored(_concentrated(rows, model, keys), "concentrated")
    best = model.groupBy(group).agg(F.min(F.struct("det", "start")).alias("best")).select(group, F.col("best.start").alias("start"))
    model = stored(model.join(small(stored(best, "best")), keys, "left_semi").drop("start"), "least")
    for _ in range(MORE_STEPS):
        step = stored(_concentrated(rows, model, [group]), "concentrated")
        fell = stored(step.alias("s").join(small(model.select(group, F.col("det").alias("_was"))), group).where(F.col("det") < F.col("_was") * (1 - 1e-9)).drop("_was"), "fallen")
        if not fell.limit(1).count():
            break
        model = stored(model.join(small(fell.select(group)), group, "left_anti").unionByName(fell), "least")
    half = _quantile(rows.join(small(model), group).withColumn("level", _level(_distance())), [group], "level", 0.5, "half")
    # never below 1: the least spread already widens groups that agree closely
    factor = F.greatest(F.expm1(F.col("half") / 200.0) / CHI2_MEDIAN[DIMS], F.lit(1.0))
    return model.join(half, group).withColumn("factor", factor).drop("half")


def quality_verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Per row: key, the statistics, base_failed, distance (null if base_failed) and kept."""
    n, r = F.col("n_words"), F.col("n_repeat_words")
    base = (n < 50) | (100 * r > 50 * n)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    stats = text_statistics(df.select(F.col(key).alias("_key"), name(lang).alias("_lang"), F.concat_ws("\t", name(lang), name(source)).alias("_source"), F.col(text).alias("_text")), "_text").drop("_text")
    stats = stored(stats.withColumn("base_failed", base).withColumns({f"x_{i}": c for i, c in enumerate(_vector())}), "stats")
    good = stats.where("not base_failed")
    by_source = stored(good.groupBy("_source").agg(F.count("*").alias("_ns")), "sources")
    own = F.coalesce(F.col("_ns") >= min_group, F.lit(False))
    rest = good.join(small(by_source), "_source").where(~own).groupBy("_lang").agg(F.count("*").alias("_nl"))
    by_lang = stored(rest, "languages")
    group = F.when(own, F.col("_source")).when(F.coalesce(F.col("_nl") >= min_group, F.lit(False)), F.col("_lang")).otherwise(F.lit("*"))
    grouped = stats.join(small(by_source), "_source", "left").join(small(by_lang), "_lang", "left").withColumn("grp", group)
    rows = stored(grouped.where("not base_failed").select("grp", *[f"x_{i}" for i in range(DIMS)]), "vectors")
    model = stored(covariance_determinant(rows), "estimates")
    out = grouped.join(small(model), "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("factor")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("distance")
