"""Quality rules: plain limits, then robust multivariate outliers, in DataFrame operations only.

Texts that pass the plain limits become vectors of transformed statistics.  For every language and
source the minimum covariance determinant is sought by concentration steps: take the share of
vectors with the smallest Mahalanobis distances, estimate centre and scatter on them, repeat until
no group's determinant falls any more.  Steps begin at three deterministic robust starts, and the
one that ends with the smallest determinant wins.  All sums are partially aggregated, so that a
group of any size costs a row for each task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import small
from .storage import discard, stored

GAP = r"[\x20\x09-\x0D]+"
DIMS = ["word_length", "symbols", "dup_lines", "repeats"]
#: The part of a statistic's deviation in all texts that is added to every group's, so that a
#: matrix of a group in which the statistic never varies can be inverted.
RIDGE = 0.05
#: Rank error of medians and cuts: one in so many rows of a group; smaller groups are exact.
ACCURACY = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_statistics(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of anything but blanks and the control characters 9 to 13.  Repeated words are
    those in a window of three words that stands in the text twice or more: the windows' hashes are
    sorted with their positions, equal neighbours give the positions, and each covers up to three
    words that the one before doesn't.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = df.select(*id_cols, text.alias("__text"), F.array_remove(F.split(text, GAP), "").alias("__words"))
    windows = F.expr("if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(2, size(__words) - 1), i -> xxhash64(__words[i - 2], __words[i - 1], __words[i])))")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(
        *id_cols,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        windows.alias("__windows"),
    )
    step = step.select(
        *id_cols,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(array_distinct(__windows)) = size(__windows), null, array_sort(transform(__windows, (h, i) -> named_struct('h', h, 'i', i))))").alias("__sorted"),
    )
    found = F.expr("sort_array(transform(filter(__sorted, (p, k) -> p.h = get(__sorted, k - 1).h or p.h = get(__sorted, k + 1).h), p -> p.i))")
    step = step.select(*[c for c in step.columns if c != "__sorted"], found.alias("__found"))
    covered = F.expr("aggregate(__found, named_struct('last', -3, 'n', 0), (s, p) -> named_struct('last', p, 'n', s.n + least(3, p - s.last)), s -> s.n)")
    return step.select(*[c for c in step.columns if c != "__found"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def chi_square(dims: int, x: float) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def chi_square_quantile(dims: int, p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(dims, middle) < p else (low, middle)
    return low


def _chance() -> dict[str, Column]:
    """Per statistic: what chance alone moves it in a text of this length.

    A mean word length is a mean over the words; a number of symbols counts rare events, whose root
    has the deviation 0.5; a duplicate line is half a line of chance, and repeats one line's words.
    """
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "word_length": 0.25 / F.sqrt(words),
        "symbols": 0.5 / F.sqrt(words),
        "dup_lines": F.least(0.5 / lines, F.lit(0.15)),
        "repeats": F.greatest(3 / words, F.least(1 / lines, F.lit(0.15))),
    }


def _names(*kinds: str) -> list[str]:
    return [f"{x}_{i}_{j}" for x in kinds for i in range(len(DIMS)) for j in range(i + 1)]


def _factor(of) -> list[Column]:
    """Columns ``l_<i>_<j>``, the Cholesky factor of the matrix ``of(i, j)``; each uses those before."""
    out = []
    for i in range(len(DIMS)):
        for j in range(i + 1):
            value = of(i, j)
            for t in range(j):
                value = value - F.col(f"l_{i}_{t}") * F.col(f"l_{j}_{t}")
            out.append((F.sqrt(F.greatest(value, F.lit(1e-24))) if i == j else value / F.col(f"l_{j}_{j}")).alias(f"l_{i}_{j}"))
    return out


def _inverse() -> list[Column]:
    """Columns ``k_<i>_<j>``, the inverse of the factor, and ``log_det`` of the matrix."""
    out = []
    for i in range(len(DIMS)):
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else F.lit(0.0)
            for t in range(j, i):
                value = value - F.col(f"l_{i}_{t}") * F.col(f"k_{t}_{j}")
            out.append((value / F.col(f"l_{i}_{i}")).alias(f"k_{i}_{j}"))
    return [*out, sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(DIMS))), F.lit(0.0)).alias("log_det")]


def _shapes(rows: DataFrame, ridge: list[float], of=F.col) -> DataFrame:
    """Centre ``m_<i>``, scatter ``c_<i>_<j>`` with the ridge, inverse factor and log determinant of
    the vectors ``of(x_<i>)``, a row for each group and start."""
    p = range(len(DIMS))
    x = [of(f"x_{i}") for i in p]
    moments = rows.groupBy("g", "start").agg(*[F.avg(x[i]).alias(f"m_{i}") for i in p], *[F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i in p for j in range(i + 1)])
    scatter = [(F.coalesce(F.col(f"c_{i}_{j}"), F.lit(0.0)) + (ridge[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in p for j in range(i + 1)]
    ready = moments.select("g", "start", *[f"m_{i}" for i in p], *scatter)
    whole = ready.select("*", *_factor(lambda i, j: F.col(f"c_{i}_{j}"))).select("*", *_inverse())
    return whole.select("g", "start", *[f"m_{i}" for i in p], *_names("c", "k"), "log_det")


def _distance(of=None) -> Column:
    """Squared Mahalanobis distance to the joined centre and factor, or of ``of(x_<i>)`` to zero."""
    off = [of(f"x_{i}") if of else F.col(f"x_{i}") - F.col(f"m_{i}") for i in range(len(DIMS))]
    rows = [sum((F.col(f"k_{i}_{j}") * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(DIMS))]
    return sum((r * r for r in rows), F.lit(0.0))


def _with(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    right = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    met = same[0] if len(same) == 1 else same[0] & same[1]
    return df.join(small(right), met).drop(*[f"__{k}" for k in keys])


def _nearest(scored: DataFrame, share: float) -> DataFrame:
    """The share of each group and start with the smallest ``d``."""
    cut = scored.groupBy("g", "start").agg(F.percentile_approx("d", share, ACCURACY).alias("cut"))
    return _with(scored, stored(cut, "mcd-cuts"), "g", "start").where(F.col("d") <= F.col("cut"))


def covariance_shapes(vectors: DataFrame, share: float, ridge: list[float], trials: int = 2, least_gain: float = 1e-6) -> DataFrame:
    """The minimum covariance determinant of each group of ``vectors(g, x_0, x_1, ...)``.

    Vectors are centred and scaled by median and median deviation.  The starts are half of them: the
    shortest, and the shortest by the own covariance of two bounded transforms, hyperbolic tangent
    and spatial sign.  After ``trials`` steps the best start of each group goes on alone, until no
    determinant falls by more than ``least_gain`` of itself; a step that doesn't lower it is undone.
    """
    p = range(len(DIMS))
    middle = vectors.groupBy("g").agg(*[F.percentile_approx(f"x_{i}", 0.5, ACCURACY).alias(f"a_{i}") for i in p])
    middle = stored(middle, "mcd-medians")
    spread = _with(vectors, middle, "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(f"x_{i}") - F.col(f"a_{i}")), 0.5, ACCURACY).alias(f"b_{i}") for i in p])
    robust = stored(_with(middle, spread, "g").select("g", *[f"a_{i}" for i in p], *[(F.lit(1.4826) * F.col(f"b_{i}") + ridge[i]).alias(f"b_{i}") for i in p]), "mcd-spreads")

    z = [(F.col(f"x_{i}") - F.col(f"a_{i}")) / F.col(f"b_{i}") for i in p]
    far = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    turns = [z, [F.tanh(v) for v in z], [F.coalesce(F.try_divide(v, far), F.lit(0.0)) for v in z]]
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), *[v.alias(f"u_{i}") for i, v in enumerate(turn)]) for k, turn in enumerate(turns)]))
    bent = _with(vectors, robust, "g").select("g", *[f"x_{i}" for i in p], starts.alias("s")).select("g", *[f"x_{i}" for i in p], "s.*")

    def turned(name: str) -> Column:
        return F.col(name.replace("x", "u"))

    first = stored(_shapes(bent, [0.1] * len(DIMS), turned), "mcd-starts")
    length = sum((F.col(f"u_{i}") * F.col(f"u_{i}") for i in p), F.lit(0.0))
    apart = F.when(F.col("start") == 0, length).otherwise(_distance(turned)).alias("d")
    half = _nearest(_with(bent, first, "g", "start").select("g", "start", *[f"x_{i}" for i in p], apart), 0.5)
    shapes, step = stored(_shapes(half, ridge), "mcd-shapes"), 0
    while True:
        if step == trials:
            names = [c for c in shapes.columns if c != "g"]
            best = shapes.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("log_det", "start")).alias("s"))
            shapes = stored(best.select("g", "s.*"), "mcd-shapes")
        scored = _with(vectors, shapes, "g").select("g", "start", *[f"x_{i}" for i in p], _distance().alias("d"))
        fresh = _shapes(_nearest(scored, share), ridge)
        names = [c for c in shapes.columns if c not in ("g", "start")]
        old = shapes.select(F.col("g").alias("__g"), F.col("start").alias("__start"), F.struct(*names).alias("old"))
        both = fresh.select("g", "start", F.struct(*names).alias("new")).join(old, (F.col("g") == F.col("__g")) & (F.col("start") == F.col("__start")))
        # The first step goes from half of the vectors to the share: its determinant may rise.
        better = F.lit(step == 0) | (F.col("new.log_det") < F.col("old.log_det") - least_gain)
        taken = stored(both.select("g", "start", better.alias("moved"), F.when(better, F.col("new")).otherwise(F.col("old")).alias("s")).select("g", "start", "moved", "s.*"), "mcd-shapes")
        settled = step >= trials and taken.where("moved").isEmpty()
        shapes, step = taken.drop("moved"), step + 1
        if settled:
            return shapes.drop("start")


def _described(df: DataFrame, row: Column, min_words: int = 50, repeat_percent: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``row``, the counts, base_failed, the groups of_lang and of_both and the statistics ``x_<i>``."""
    named = df.select(row.alias("row"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counted = base_statistics(named, ["row", "lang", "source"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    n = F.greatest("n_words", F.lit(1))
    statistics = {
        "word_length": F.log(F.greatest("word_chars", F.lit(1)) / n),
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
    }
    return counted.select(
        "row",
        *COUNTS,
        "n_lines",
        failed.alias("base_failed"),
        key(F.col("lang")).alias("of_lang"),
        F.concat(key(F.col("lang")), F.lit("\n"), key(F.col("source"))).alias("of_both"),
        *[statistics[d].alias(f"x_{i}") for i, d in enumerate(DIMS)],
    )


def _fitted(facts: DataFrame, share: float, min_group: int) -> DataFrame:
    """``(b, level, centre, scatter)``: by which estimate each language and source of the stored ``facts``
    is judged."""
    p = range(len(DIMS))
    passing = facts.where(~F.col("base_failed")).select("of_lang", "of_both", *[f"x_{i}" for i in p])
    spread = passing.agg(*[F.stddev_pop(f"x_{i}") for i in p]).first()
    ridge = [max(1e-6, RIDGE * (s or 0.0)) for s in spread]
    pairs = stored(passing.groupBy("of_lang", "of_both").count(), "quality-groups")
    langs = pairs.groupBy(F.col("of_lang").alias("l")).agg(F.sum("count").alias("in_lang"))
    level = F.when(F.col("count") >= min_group, "group").when(F.col("in_lang") >= min_group, "language").otherwise("all")
    levels = pairs.join(langs, F.col("of_lang") == F.col("l")).select(F.col("of_both").alias("b"), "of_lang", level.alias("level"))
    levels = stored(levels.withColumn("g", F.when(F.col("level") == "group", F.col("b")).when(F.col("level") == "language", F.col("of_lang")).otherwise("")), "quality-levels")
    # A pooled group is estimated on all texts of its language, or on all texts.
    uses = levels.where("level = 'group'").select("b", "g")
    pooled = levels.where("level = 'language'").select(F.col("g").alias("pool")).distinct()
    uses = uses.unionByName(levels.join(pooled, F.col("of_lang") == F.col("pool")).select("b", F.col("pool").alias("g")))
    if not levels.where("level = 'all'").isEmpty():
        uses = uses.unionByName(levels.select("b", F.lit("").alias("g")))
    uses = stored(uses, "quality-uses")
    vectors = passing.select("of_both", *[f"x_{i}" for i in p]).join(small(uses), F.col("of_both") == F.col("b")).select("g", *[f"x_{i}" for i in p])
    vectors = stored(vectors, "quality-vectors")
    shapes = covariance_shapes(vectors, share, ridge)
    shaped = levels.join(shapes.withColumnRenamed("g", "__g"), F.col("g") == F.col("__g")).drop("__g", "g", "of_lang", *_names("k"), "log_det")
    shaped = stored(shaped, "quality-shapes")
    discard(vectors)
    return shaped


def _judged(facts: DataFrame, shaped: DataFrame, share: float, tail: float) -> DataFrame:
    """``row``, the counts, base_failed, level, distance and kept, for every row of ``facts``."""
    p = range(len(DIMS))
    judged = facts.join(small(shaped), F.col("of_both") == F.col("b"), "left")
    # Consistency: the scatter of the nearest share, stretched to that of all for normal vectors.
    factor = share / chi_square(len(DIMS) + 2, chi_square_quantile(len(DIMS), share))
    limit = chi_square_quantile(len(DIMS), 1 - tail)
    chance = _chance()
    scatter = _factor(lambda i, j: factor * F.col(f"c_{i}_{j}") + (chance[DIMS[i]] * chance[DIMS[i]] if i == j else 0.0))
    solved = []
    for i in p:
        off = F.col(f"x_{i}") - F.col(f"m_{i}")
        for j in range(i):
            off = off - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        solved.append((off / F.col(f"l_{i}_{i}")).alias(f"y_{i}"))
    judged = judged.select("row", *COUNTS, "base_failed", "level", *[f"{x}_{i}" for x in "xm" for i in p], *scatter).select("*", *solved)
    distance = F.when(~F.col("base_failed"), sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in p), F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= limit)
    return judged.select("row", *COUNTS, "base_failed", F.when(~F.col("base_failed"), F.col("level")).alias("level"), distance.alias("distance"), kept.alias("kept"))


def rules(df: DataFrame, id_col: str = "doc_id", share: float = 0.75, tail: float = 1e-4, min_group: int = 40, **options) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, level, distance, kept)``.

    A text fails the base rules with fewer than ``min_words`` words, or if more than
    ``repeat_percent`` of its words are repeated; null text has none.  Of the others those stay
    whose distance is within the chi-square quantile of 1 - ``tail``.  The distance is measured by
    the group's own scatter, plus what chance moves in a text of this length: one symbol or
    duplicate line in a short text is none, many in a group without any are an outlier.  A null
    language or source is a group of its own.  An estimate needs ``min_group`` texts: smaller groups
    are estimated with their whole language, and those of languages that small with all texts;
    ``level`` says by which a text that passed the base rules was judged: group, language or all.
    Every row of ``df`` gives one row, repeated or null ids included; other columns are ignored.
    """
    facts = stored(_described(df, F.struct(F.col(id_col).alias("id")), **options), "quality-facts")
    out = _judged(facts, _fitted(facts, share, min_group), share, tail)
    return out.select(F.col("row.id").alias(id_col), *[c for c in out.columns if c != "row"])


def passing(df: DataFrame, share: float = 0.75, tail: float = 1e-4, min_group: int = 40, **options) -> DataFrame:
    """The rows of ``df`` that the rules keep, each by its own verdict: null and repeated ids, repeated
    rows and any column names are no matter.

    Statistics are stored without the rows, for the estimates; each row is then judged in a second
    scan, so that no text is copied or shuffled.
    """
    facts = stored(_described(df, F.lit(0), **options), "quality-facts")
    shaped = _fitted(facts, share, min_group)
    discard(facts)
    judged = _judged(_described(df, F.struct(*df.columns), **options), shaped, share, tail).select("row", "kept")
    # A filter right above would have the optimizer write out every alias below it in its constraints,
    # without end; none go through an unpivot.
    return judged.unpivot(["row"], ["kept"], "verdict", "keep").where("keep").select("row.*")
