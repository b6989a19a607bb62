"""Class balance by repeatable sampling, and class weights.

A row is kept by comparing a hash of its keys with a fraction: the same rows on every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expressions import class_weight
from panelspark.functions.hashing import unit_hash
from panelspark.functions.ranking import global_rank

WEIGHTS = ("balanced", "sqrt", "none")
#: Hash ranges in which an exact sample counts rows.
SLOTS = 1 << 16


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: n_pos, n_neg."""
    return df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))


def _counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = class_counts(df, label).first()
    return row["n_pos"], row["n_neg"]


def random_fraction(df: DataFrame, fraction: float, keys: list[str], seed: int = 42) -> DataFrame:
    return df.where(unit_hash(keys, seed) < fraction)


def exact_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hashes, ties by key; all of a smaller frame.

    A histogram of ``SLOTS`` hash ranges finds the one that holds the n-th row: rows of lower ranges
    pass a filter, and only the rows of that range are ranked.
    """
    u = unit_hash(keys, seed)
    slot = F.floor(u * SLOTS).cast("int")
    so_far = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = df.groupBy(slot.alias("slot")).agg(F.count("*").alias("own")).withColumn("reached", F.sum("own").over(so_far))
    edge = counts.where(F.col("reached") >= n).orderBy("slot").first() if n > 0 else None
    if edge is None:
        return df if n > 0 else df.where(F.lit(False))
    ranked = global_rank(df.where(slot == edge["slot"]).withColumn("__u", u), [F.col("__u"), *map(F.col, keys)], "__rank")
    few = ranked.where(F.col("__rank") <= n - (edge["reached"] - edge["own"])).select(*df.columns)
    return df.where(slot < edge["slot"]).unionByName(few)


def stratified(df: DataFrame, label: str, fraction: float, keys: list[str], seed: int = 42) -> DataFrame:
    """The same fraction of classes 0 and 1; other labels go."""
    return df.where(F.col(label).isin(0, 1) & (unit_hash(keys, seed) < fraction))


def negatives_wanted(n_pos: int, ratio: float | None, floor: int = 100) -> int:
    return max(int(n_pos / ratio) if ratio else n_pos, floor)


def undersample(df: DataFrame, label: str, keys: list[str], ratio: float | None = None, seed: int = 42, floor: int = 100, fraction: float = 1.0, exact: bool = False) -> DataFrame:
    """All positives and about ``n_pos / ratio`` negatives, ``floor`` at least.

    ``fraction`` then keeps a part of both by an independent hash.  ``exact`` takes the negatives
    with the smallest hashes in just that number.  If a class is absent, ``df`` is returned.
    """
    n_pos, n_neg = _counts(df, label)
    if not n_pos or not n_neg:
        return df
    wanted = negatives_wanted(n_pos, ratio, floor)
    if exact:
        few = exact_sample(df.where(F.col(label) == 0), min(wanted, n_neg), keys, seed)
        out = df.where(F.col(label) == 1).unionByName(few)
    else:
        out = df.where((F.col(label) == 1) | ((F.col(label) == 0) & (unit_hash(keys, seed) < min(wanted / n_neg, 1.0))))
    return out if fraction >= 1 else out.where(unit_hash(keys, seed + 1) < fraction)


def oversample(df: DataFrame, label: str, keys: list[str], ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Positives repeated to about ``n_neg * ratio``; ``df``'s classes 0 and 1 if that is no more.

    Each positive gets the whole part of the factor, and one more by its hash.
    """
    n_pos, n_neg = _counts(df, label)
    wanted = int(n_neg * ratio) if ratio else n_neg
    both = df.where(F.col(label).isin(0, 1))
    if not n_pos or wanted <= n_pos:
        return both
    factor = wanted / n_pos
    more = F.lit(int(factor)) + (unit_hash(keys, seed) < factor - int(factor)).cast("int")
    copies = F.when(F.col(label) == 1, more).otherwise(F.lit(1))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")


def negative_fraction(df: DataFrame, label: str, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    return df.where((F.col(label) == 1) | (unit_hash(keys, seed) < fraction))


def effect(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """A row for each class: rows before and after sampling."""
    marked = before.select(label, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(label, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return marked.groupBy(F.col(label).alias("label")).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))


def weight_of_positives(n_pos: Column, n_neg: Column, strategy: str = "balanced", cap: float | None = None) -> Column:
    """``n_neg / n_pos``, its root, or 1; 1 without positives; never above ``cap``."""
    if strategy not in WEIGHTS:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(WEIGHTS)}")
    ratio = n_neg / F.greatest(n_pos, F.lit(1))
    weight = {"balanced": ratio, "sqrt": F.sqrt(ratio), "none": F.lit(1.0)}[strategy]
    weight = F.when(n_pos > 0, weight).otherwise(F.lit(1.0))
    return weight if cap is None else F.least(weight, F.lit(float(cap)))


def class_weights(df: DataFrame, label: str, strategy: str = "balanced", cap: float | None = None) -> DataFrame:
    """One row: n_pos, n_neg, weight."""
    return class_counts(df, label).withColumn("weight", weight_of_positives(F.col("n_pos"), F.col("n_neg"), strategy, cap))


def add_weights(df: DataFrame, label: str, weight_col: str = "weight", cap: float = 50.0, strategy: str = "balanced") -> DataFrame:
    """``df`` with the weight of its class; no positives is an error."""
    row = class_weights(df, label, strategy, cap).first()
    if not row["n_pos"]:
        raise ValueError("no positives to weigh")
    return df.withColumn(weight_col, class_weight(F.col(label), F.lit(row["weight"])))


def hash_ranked(df: DataFrame, keys: list[str], seed: int, name: str = "rank") -> DataFrame:
    return global_rank(df.withColumn("__u", unit_hash(keys, seed)), [F.col("__u"), *map(F.col, keys)], name).drop("__u")


def by_strategy(df: DataFrame, label: str, keys: list[str], config: dict) -> DataFrame:
    """Dispatch on ``config['strategy']``; the other entries are the strategy's arguments."""
    rest = {k: v for k, v in config.items() if k != "strategy"}
    strategies = {
        "none": lambda: df,
        "random": lambda: random_fraction(df, keys=keys, **rest),
        "stratified": lambda: stratified(df, label, keys=keys, **rest),
        "undersample": lambda: undersample(df, label, keys, **rest),
        "oversample": lambda: oversample(df, label, keys, **rest),
        "neg_frac": lambda: negative_fraction(df, label, keys, **rest),
    }
    if config["strategy"] in ("hard_negative", "hard_negative_mixed"):
        from panelspark.operators.mining import mine

        return mine(df, label, keys, **rest)
    if config["strategy"] not in strategies:
        raise ValueError(f"unknown strategy {config['strategy']!r}")
    return strategies[config["strategy"]]()


def for_mode(df: DataFrame, label: str, keys: list[str], configs: dict[str, dict], mode: str) -> DataFrame:
    """Sampling for a mode such as ``tune`` or ``final``; a mode without a block changes nothing."""
    return by_strategy(df, label, keys, configs.get(mode, {"strategy": "none"}))
