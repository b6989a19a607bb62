"""Registered queries of the library's own operators, each beside its SQL.

Doubles that depend on the order of a sum are rounded to six places in both.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.expressions import level
from panelspark.functions.ranking import stored
from panelspark.operators import clean, curves, experiments, metrics, mining, models, panel, prep, ranker, roles, sampling, threshold
from panelspark.operators.levels import LevelRegression
from panelspark.plans.panel import KEYS, ORACLE_PANEL, TEST, TRAIN, VALID, scores, table, training
from panelspark.plans.panel import panel as panel_of
from panelspark.sources.scratch import scratch_path
from panelspark.sources.tables import Registry, Source, capped_sample, limited_handoff, numeric_handoff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the relations panel, train and scores."""

    def register(f: Query) -> Query:
        own = name or f.__name__
        QUERIES[own] = f
        if sql:
            relations = f"with panel as ({ORACLE_PANEL}), train as (select * from panel where year >= {TRAIN[0]} and year < {TRAIN[1]}), scores as ({SCORES_SQL})"
            ORACLES[own] = f"{relations}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
        return f

    return register


SCORES_SQL = "select o_orderkey as sid, round(o_totalprice / 5000) / 110.0 as score from orders where o_orderkey in (select l_orderkey from lineitem)"


def u(seed: int = 42, key: str = "sid") -> str:
    return f"((('0x' || substr(md5({key}::varchar || '|{seed}'), 1, 8))::bigint) / 4294967296.0)"


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# Sources and hand-offs


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
def scan_filter_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Source("orders", "parquet", [f"{sf_dir}/orders.parquet"], where="o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
    return source.load(spark).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"select o_orderkey from orders where {u(42, 'o_orderkey')} < 0.1")
def keyed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Source("orders", "parquet", [f"{sf_dir}/orders.parquet"], fraction=0.1, keys=["o_orderkey"])
    return source.load(spark).select("o_orderkey")


@query(f"select sid, price from panel order by {u()}, sid limit 500")
def exact_sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_sample(panel_of(spark, sf_dir), 500, KEYS).select("sid", "price")


@query("select sid, price::double as price, balance::double as balance, n_lines::double as n_lines, is_active::int::double as is_active, y::double as y from panel")
def numeric_handoff_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_handoff(panel_of(spark, sf_dir), ["price", "balance", "n_lines", "is_active"], "y", keys=KEYS)


@query("select 'orders' as name, 'parquet' as kind, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' as columns, false as cached, count(*) as n_rows from orders")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Source("orders", "parquet", [f"{sf_dir}/orders.parquet"]).describe(spark).drop("path")


@query("select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("catalog_orders")
    return Source("orders", "table", ["catalog_orders"]).load(spark).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select c_name as name, 'customer' as kind, c_acctbal as balance from customer union all select s_name, 'supplier', s_acctbal from supplier")
def registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry.from_dicts({t: {"kind": "parquet", "paths": [f"{sf_dir}/{t}.parquet"]} for t in ("customer", "supplier")})
    a = registry.load(spark, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(registry.load(spark, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus")
def frame_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing frame passes through a source as it is."""
    source = Source("orders", "frame", frame=table(spark, sf_dir, "orders"))
    kept = source.load(spark)
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderpriority, count(*) as n, (select count(*) from orders)::int as total from orders group by o_orderpriority")
def cached_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept frame serves both the count of all rows and the groups; it stays kept for the reader of the
    result, until the source or the session's cache is cleared."""
    kept = Source("orders", "parquet", [f"{sf_dir}/orders.parquet"]).cache(spark)
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.lit(kept.count()).alias("total"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    some = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    some.write.option("header", "true").csv(path)
    return Source("orders", "csv", [path], schema=some.schema).load(spark)


@query("select sid, price from panel order by sid limit 1000")
def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited_handoff(panel_of(spark, sf_dir).select("sid", "price"), ["sid"], 1000)


@query(f"select sid from panel where (select count(*) from panel) <= 5000 or {u()} < 5000.0::double / (select count(*) from panel)")
def capped_fit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped_sample(panel_of(spark, sf_dir).select("sid"), 5000, KEYS)


@query("select sid, price, cat_priority, y from panel where y = 1")
def drop_and_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives = clean.of_class(panel_of(spark, sf_dir), "y", 1)
    return roles.drop_columns(positives, ["dirty", "constant", "absent"]).select("sid", "price", "cat_priority", "y")


# Roles and cleaning

_TYPES = {"sid": "bigint", "customer_id": "bigint", "year": "int", "y": "int", "y_rare": "int", "cat_priority": "string", "cat_segment": "string", "cat_nation": "string", "low_card_int": "int", "is_active": "boolean", "flag": "int", "price": "double", "balance": "double", "n_lines": "bigint", "qty": "double", "dirty": "double", "constant": "double", "p1": "double"}
_FIXED = {"sid": "key", "y": "label", "y_rare": "drop", "year": "drop"}


def _role_sql(c: str, kind: str) -> str:
    if c in _FIXED:
        role = f"'{_FIXED[c]}'"
    elif kind in ("int", "bigint"):
        role = f"(select case when count(distinct {c}) + max(case when {c} is null then 1 else 0 end) <= 20 then 'categorical' else 'numeric' end from panel)"
    else:
        role = "'categorical'" if kind == "string" else "'numeric'"
    return f"select '{c}' as \"column\", '{kind}' as type, {role} as role"


@query(" union all ".join(_role_sql(c, k) for c, k in _TYPES.items()))
def role_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    return roles.resolve(df, "y", drop=["y_rare", "year"], keys=["sid"]).table(df)


@query("""select sid, y::double as y, coalesce(flag, 0)::double as flag, price, balance,
  case when isnan(dirty) or isinf(dirty) then null else dirty end as dirty, low_card_int::varchar as low_card_int, cat_segment from panel""")
def clean_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    binary, continuous = roles.split_numeric(df, ["flag", "price", "balance", "dirty"])
    return clean.clean(df, "y", ["low_card_int", "cat_segment"], binary, continuous, keep=KEYS)


# Splits, deduplication, class counts

_SPLIT_SQL = f"case when year >= {TRAIN[0]} and year < {TRAIN[1]} then 'train' when year >= {VALID[0]} and year < {VALID[1]} then 'valid' when year >= {TEST[0]} and year < {TEST[1]} then 'test' end"


@query(f"select split, count(*) as n, round(avg(y_rare::double), 6) as pos_rate from (select {_SPLIT_SQL} as split, y_rare from panel) where split is not null group by split")
def time_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = panel.tag_splits(panel_of(spark, sf_dir), TRAIN, TEST, VALID)
    return panel.split_summary(tagged, "y_rare").withColumn("pos_rate", r6("pos_rate"))


_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _dedup_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in _LINE)
    return f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {order}) = 1"


def _dedup(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return panel.deduplicate(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"], keep).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


@query(_dedup_sql("asc nulls first"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(spark, sf_dir, "first")


@query(_dedup_sql("desc nulls last"))
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(spark, sf_dir, "last")


@query("select distinct o_custkey, o_orderstatus, o_orderpriority from orders")
def dedup_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.deduplicate(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("select y as label, count(*) as n, (select count(*) from panel) as total, round((select avg(y::double) from panel), 6) as pos_rate from panel group by y")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.class_distribution(panel_of(spark, sf_dir), "y").withColumn("pos_rate", r6("pos_rate"))


# Sampling and weights

_NEG = "(select count(*) from train where y_rare = 0)"
_POS = "(select count(*) from train where y_rare = 1)"
_UNDER = f"(y_rare = 1 or {u()} < least(greatest(floor({_POS} / 0.5), 100)::double / {_NEG}, 1.0))"


@query(f"select sid, y_rare from train where {_UNDER}")
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(training(spark, sf_dir), "y_rare", KEYS, ratio=0.5).select("sid", "y_rare")


@query(f"select sid, y_rare from train where {_UNDER} and {u(43)} < 0.1")
def undersample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(training(spark, sf_dir), "y_rare", KEYS, ratio=0.5, fraction=0.1).select("sid", "y_rare")


@query(f"select sid, y_rare from train where y_rare = 1 union all (select sid, y_rare from train where y_rare = 0 order by {u()}, sid limit (select least(greatest(floor({_POS} / 0.5), 100), {_NEG})::bigint))")
def undersample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(training(spark, sf_dir), "y_rare", KEYS, ratio=0.5, exact=True).select("sid", "y_rare")


@query(f"select y_rare as label, count(*) as n_before, count(*) filter ({_UNDER}) as n_after from train group by y_rare")
def sampling_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = training(spark, sf_dir)
    return sampling.effect(before, sampling.undersample(before, "y_rare", KEYS, ratio=0.5), "y_rare")


@query(f"select sid, y from panel where {u()} < 0.25")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_fraction(panel_of(spark, sf_dir), 0.25, KEYS).select("sid", "y")


@query(f"select sid, y from panel where y in (0, 1) and {u(7)} < 0.3")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(panel_of(spark, sf_dir), "y", 0.3, KEYS, seed=7).select("sid", "y")


@query(f"""+ f as (select floor({_NEG} * 0.5) / {_POS} as f)
select sid, y_rare from (select sid, y_rare, case when y_rare = 1 then floor(f.f) + (case when {u()} < f.f - floor(f.f) then 1 else 0 end) else 1 end as copies from train, f), unnest(range(copies::bigint))""")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.oversample(training(spark, sf_dir), "y_rare", KEYS, ratio=0.5).select("sid", "y_rare")


@query(f"select sid, y_rare from panel where y_rare = 1 or {u(1)} < 0.2")
def neg_frac_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.negative_fraction(panel_of(spark, sf_dir), "y_rare", KEYS, 0.2, seed=1).select("sid", "y_rare")


def _weights(strategy: str, cap: float | None) -> None:
    ratio = {"balanced": "n_neg / n_pos", "sqrt": "sqrt(n_neg / n_pos)"}[strategy]
    value = ratio if cap is None else f"least({ratio}, {cap}::double)"
    name = f"class_weights_{'capped' if cap else strategy}"

    @query(f"select n_pos, n_neg, round({value}, 6) as weight from (select count(*) filter (y_rare = 1) as n_pos, count(*) filter (y_rare = 0) as n_neg from train)", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sampling.class_weights(training(spark, sf_dir), "y_rare", strategy, cap).withColumn("weight", r6("weight"))


for _strategy, _cap in (("balanced", None), ("sqrt", None), ("balanced", 5.0)):
    _weights(_strategy, _cap)


@query(f"select sid, y_rare, round(case when y_rare = 1 then least({_NEG}::double / {_POS}, 50.0) else 1.0 end, 6) as weight from train")
def weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.add_weights(training(spark, sf_dir), "y_rare").select("sid", "y_rare", r6("weight").alias("weight"))


@query(f"select 'tune' as mode, sid, y_rare from train where y_rare = 1 or {u(1)} < 0.2 union all select 'other', sid, y_rare from train")
def mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = {"tune": {"strategy": "neg_frac", "fraction": 0.2, "seed": 1}}
    parts = [sampling.for_mode(training(spark, sf_dir), "y_rare", KEYS, configs, m).select(F.lit(m).alias("mode"), "sid", "y_rare") for m in ("tune", "other")]
    return parts[0].unionByName(parts[1])


@query(f"select sid, row_number() over (order by {u()}, sid) as rank from panel")
def hash_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_ranked(panel_of(spark, sf_dir).select("sid"), KEYS, 42)


# Mining


@query("select p.sid, coalesce(s.score, 0.0) as score from panel p left join scores s using (sid)")
def scores_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.with_scores(panel_of(spark, sf_dir), scores(spark, sf_dir), KEYS).select("sid", "score")


@query("select sid, round((score - (select min(score) from scores)) / ((select max(score) from scores) - (select min(score) from scores) + 1e-10), 6) as score from scores")
def score_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.normalised(scores(spark, sf_dir)).select("sid", r6("score").alias("score"))


_HARD = {
    "top_prob": "-score",
    "margin": "abs(score - 0.5)",
    "entropy": "-(-score * ln(score + 1e-10) - (1 - score) * ln(1 - score + 1e-10))",
}


@query(" union all ".join(f"select sid, '{m}' as method, row_number() over (order by round({e}, 12), {u()}, sid) as rank from scores" for m, e in _HARD.items()))
def mining_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [mining.mining_order(scores(spark, sf_dir), KEYS, m).select("sid", F.lit(m).alias("method"), "rank") for m in _HARD]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _hard_sql(method: str, hard: str) -> str:
    """The relation ``mined(sid, origin, score)``; ``hard`` is the number of hard negatives of target(n)."""
    return f"""+ neg as (select t.sid, coalesce(s.score, 0.0) as score from train t left join scores s using (sid) where t.y_rare = 0),
    target as (select least(greatest(floor({_POS} / 0.5), 100), {_NEG}) as n),
    ranked as (select sid, score, row_number() over (order by round({_HARD[method]}, 12), {u()}, sid) as rank from neg),
    rest as (select sid, score, row_number() over (order by {u()}, sid) as k from ranked where rank > (select {hard} from target)),
    mined as (select sid, 'positive' as origin, coalesce(s.score, 0.0) as score from train left join scores s using (sid) where y_rare = 1
    union all select sid, 'hard', score from ranked where rank <= (select {hard} from target)
    union all select sid, 'random', score from rest where k <= (select n - {hard} from target))"""


def _hard(name: str, method: str, hard: str = "floor(n * 0.6)", **options) -> None:
    @query(f"{_hard_sql(method, hard)} select sid, origin from mined", f"hard_neg_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mining.hard_negatives(training(spark, sf_dir), "y_rare", KEYS, scores(spark, sf_dir), ratio=0.5, method=method, **options).select("sid", "origin")


for _method in _HARD:
    _hard(_method, _method)
_hard("per_positive", "top_prob", f"least(n, floor(1.5 * {_POS}))", hard_per_pos=1.5)
_hard("quota", "margin", f"least(floor(n * 0.6), ceil(0.01 * {_NEG}))", q=0.01)


@query("""+ joined as (select t.sid, t.y_rare, coalesce(s.score, 0.0) as score from train t left join scores s using (sid))
select sid, y_rare from joined where y_rare = 1 or score >= (select quantile_disc(score, 0.8) from joined where y_rare = 0)""")
def hard_neg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = mining.with_scores(training(spark, sf_dir), scores(spark, sf_dir), KEYS)
    return mining.above_percentile(joined, "y_rare", 0.8).select("sid", "y_rare")


@query(f"{_hard_sql('top_prob', 'floor(n * 0.6)')} select origin, count(*) as n, round(avg(score), 6) as mean_score, min(score) as min_score, max(score) as max_score from mined group by origin")
def hard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = mining.hard_negatives(training(spark, sf_dir), "y_rare", KEYS, scores(spark, sf_dir), ratio=0.5)
    return mining.hard_summary(mined).withColumn("mean_score", r6("mean_score"))


# Preprocessing

_FINITE = "(select * replace (case when isnan(dirty) or isinf(dirty) then null else dirty end as dirty) from panel)"


def _finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    return df.withColumn("dirty", F.when(~(F.isnan("dirty") | (F.abs("dirty") == float("inf"))), F.col("dirty")))


def _impute(strategy: str) -> None:
    fill = {"mean": "avg({0})", "median": "quantile_cont({0}, 0.5)", "constant": "max(-1.0)"}

    def sql_of(c: str) -> str:
        if strategy == "mode":
            return f"coalesce({c}, (select {c} from {_FINITE} where {c} is not null group by {c} order by count(*) desc, {c} limit 1))"
        return f"coalesce({c}, (select {fill[strategy].format(c)} from {_FINITE}))"

    @query(f"select sid, round(({sql_of('dirty')})::double, 6) as dirty, round(({sql_of('qty')})::double, 6) as qty from {_FINITE}", f"impute_{strategy}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _finite(spark, sf_dir)
        stats = prep.numeric_stats(df, dict.fromkeys(("dirty", "qty"), prep.NEEDS.get(strategy, set())))
        return df.select("sid", *[r6(prep.imputed(F.col(c), strategy, stats[c], -1.0)).alias(c) for c in ("dirty", "qty")])


for _strategy in ("mean", "median", "mode", "constant"):
    _impute(_strategy)


@query("select sid, coalesce(cat_segment, (select cat_segment from panel where cat_segment is not null group by 1 order by count(*) desc, 1 limit 1)) as cat_segment from panel")
def impute_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    plan = prep.Preprocessor([], ["cat_segment"], categorical_imputation="most_frequent").fit(df)
    return df.select("sid", plan._filled("cat_segment").alias("cat_segment"))


@query("select sid, coalesce(cat_segment, '__missing__') as cat_segment from panel")
def missing_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of(spark, sf_dir).select("sid", level(F.col("cat_segment")).alias("cat_segment"))


def _index_sql(column: str, order: str, where: str = "true") -> str:
    return f"(select {column} as v, (row_number() over (order by {order}) - 1)::int as i from (select {column}, count(*) as n from panel where {column} is not null and {where} group by 1))"


@query(f"select sid, m.i as cat_nation_index from panel join {_index_sql('cat_nation', 'n desc, cat_nation')} m on m.v = cat_nation")
def label_encode_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    return prep.encode_index(df, "cat_nation", prep.category_levels(df, ["cat_nation"])).select("sid", "cat_nation_index")


@query(f"select sid, coalesce(m.i, -1) as cat_segment_index from panel left join {_index_sql('cat_segment', 'cat_segment')} m on m.v = cat_segment")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    return prep.encode_index(df, "cat_segment", prep.category_levels(df, ["cat_segment"], "by_name"), "by_name", "minus").select("sid", "cat_segment_index")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("select sid, " + ", ".join(f"(coalesce(cat_priority = '{v}', false))::int as \"cat_priority={v}\"" for v in _PRIORITIES) + " from panel")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.one_hot(panel_of(spark, sf_dir), "cat_priority", list(_PRIORITIES)).select("sid", *[F.col(f"`cat_priority={v}`") for v in _PRIORITIES])


@query("""+ m as (select coalesce(cat_segment, '__missing__') as v, (sum(y)::double + 10.0 * (select avg(y::double) from panel)) / (count(*) + 10.0) as t from panel group by 1)
select sid, round(m.t, 6) as target_mean from panel join m on m.v = coalesce(cat_segment, '__missing__')""")
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    means = prep.target_means(df, "cat_segment", "y")
    return prep.lookup(df, level(F.col("cat_segment")), means, "target_mean", "target_mean", F.lit(None)).select("sid", r6("target_mean").alias("target_mean"))


_KNOWN = "cat_nation >= 'F'"


@query(f"""+ m as {_index_sql('cat_nation', 'n desc, cat_nation', _KNOWN)}
select sid, 'keep' as policy, coalesce(m.i, (select count(*) from m))::int as code from panel left join m on m.v = cat_nation
union all select sid, 'minus', coalesce(m.i, -1) from panel left join m on m.v = cat_nation
union all select sid, 'skip', m.i from panel join m on m.v = cat_nation""")
def unknown_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    levels = prep.category_levels(df.where(_KNOWN), ["cat_nation"])
    parts = [prep.encode_index(df, "cat_nation", levels, unknown=p, name="code").select("sid", F.lit(p).alias("policy"), "code") for p in ("keep", "minus", "skip")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SCALE = {
    "standard": "({0} - (select avg({0}) from panel)) / (select stddev_samp({0}) from panel)",
    "minmax": "({0} - (select min({0}) from panel)) / ((select max({0}) from panel) - (select min({0}) from panel))",
    "robust": "({0} - (select quantile_cont({0}, 0.5) from panel)) / (select quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) from panel)",
}


def _scale(strategy: str) -> None:
    flat = "0.5" if strategy == "minmax" else "0.0"
    cells = ", ".join(f"round({_SCALE[strategy].format(c)}, 6) as {c}" for c in ("price", "balance"))

    @query(f"select sid, {cells}, {flat}::double as constant from panel", f"scale_{strategy}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = panel_of(spark, sf_dir)
        stats = prep.numeric_stats(df, dict.fromkeys(("price", "balance", "constant"), prep.NEEDS[strategy]))
        return df.select("sid", *[r6(prep.scaled(F.col(c), strategy, stats[c])).alias(c) for c in ("price", "balance", "constant")])


for _strategy in _SCALE:
    _scale(_strategy)


@query(f"""select sid, round({_SCALE['minmax'].format('price')}, 6) as price, coalesce(qty, -1.0)::double as qty, is_active::int::double as is_active,
  m.i as cat_priority_index from panel join {_index_sql('cat_priority', 'cat_priority')} m on m.v = cat_priority""")
def column_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = {"price": prep.ColumnPlan(scaling="minmax"), "qty": prep.ColumnPlan(imputation="constant", value=-1.0, scaling="none"), "cat_priority": prep.ColumnPlan(encoding="ordinal")}
    df = panel_of(spark, sf_dir)
    out = prep.Preprocessor(["price", "qty"], ["cat_priority"], boolean=["is_active"], plans=plans).fit(df).transform(df, keep=KEYS)
    return out.withColumn("price", r6("price"))


@query("select sid, is_active::int::double as is_active from panel")
def bool_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    return prep.Preprocessor([], [], boolean=["is_active"]).fit(df).transform(df, keep=KEYS)


@query("""+ m as (select v, (row_number() over (order by n desc, v) - 1)::int as i from (select coalesce(cat_segment, '__missing__') as v, count(*) as n from panel group by 1))
select sid, m.i as cat_segment_index from panel join m on m.v = coalesce(cat_segment, '__missing__')""")
def native_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    return prep.Preprocessor([], ["cat_segment"], encoding="native").fit(df).transform(df, keep=KEYS)


_POLICIES = ("keep", "skip")


def _policy_sql(encoding: str, policy: str) -> str:
    seen = f"(select * from panel where {_KNOWN})"
    tables = {
        "label": f"(select v, (row_number() over (order by n desc, v) - 1)::double as code from (select cat_nation as v, count(*) as n from {seen} group by 1))",
        "ordinal": f"(select v, (row_number() over (order by v) - 1)::double as code from (select distinct cat_nation as v from {seen}))",
        "one_hot": f"(select v, (row_number() over (order by v))::double as code from (select distinct cat_nation as v from {seen}))",
        "target": f"(select cat_nation as v, (sum(y)::double + 10.0 * (select avg(y::double) from {seen})) / (count(*) + 10.0) as code from {seen} group by 1)",
    }
    unknown = {"label": f"(select count(distinct cat_nation) from {seen})::double", "ordinal": "-1.0::double", "one_hot": "0.0::double", "target": f"(select avg(y::double) from {seen})"}
    code = "m.code" if policy == "skip" else f"coalesce(m.code, {unknown[encoding]})"
    return f"select '{encoding}' as encoding, '{policy}' as policy, sid, round({code}, 6) as code from panel {'' if policy == 'skip' else 'left '}join {tables[encoding]} m on m.v = cat_nation"


@query(" union all ".join(_policy_sql(e, p) for e in ("label", "ordinal", "one_hot", "target") for p in _POLICIES))
def encoding_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each encoding learned without some nations, and what each policy makes of them; the code of a
    one-hot row is the place of its 1, from 1, or 0."""
    df, parts = panel_of(spark, sf_dir), []
    seen = df.where(_KNOWN)
    for encoding in ("label", "ordinal", "one_hot", "target"):
        fitted = prep.Preprocessor([], ["cat_nation"], "y", encoding=encoding).fit(seen)
        for policy in _POLICIES:
            fitted.unknown = policy
            out = fitted.transform(df, keep=KEYS)
            cells = [F.col(f"`{c}`").cast("double") * (k if encoding == "one_hot" else 1) for k, c in enumerate(out.columns[1:], 1)]
            parts.append(out.select(F.lit(encoding).alias("encoding"), F.lit(policy).alias("policy"), "sid", r6(sum(cells, F.lit(0.0))).alias("code")))
    return functools.reduce(DataFrame.unionByName, parts)


@query("select sid, low_card_int % 2 as label, low_card_int % 2 as predicted from panel")
def native_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split of one tree parts nations whose numbers alternate, as it sees them as categories."""
    df = panel_of(spark, sf_dir).withColumn("label", F.col("low_card_int") % 2)
    one = {"numTrees": 1, "maxDepth": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "bootstrap": False}
    pipeline = experiments.Pipeline(prep.Preprocessor([], ["cat_nation"], "label", encoding="native"), models.Classifier("rf", "label", params=one), KEYS)
    return pipeline.fit(df).predict(df).select("sid", "label", "predicted")


@query("select count(*) as n, count(distinct l_orderkey) as features, count(*) filter (l_orderkey % 2 = 1) as positives, true as good from lineitem")
def wide_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature for each order, as many as there are, and a regression on these vectors; each is kept as
    the place of its 1, and names and coefficients in tables."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("string").alias("order"), (F.col("l_orderkey") % 2).cast("int").alias("label"))
    fitted = prep.Preprocessor([], ["order"], "label", max_one_hot=None).fit(lines)
    vectors = stored(fitted.places(lines, keep=["label"]), "places")
    model = LevelRegression("label", ["order_place"], params={"maxIter": 10, "regParam": 1e-4}).fit(vectors)
    return model.predict(vectors).agg(F.count("*").alias("n"), F.lit(fitted.n_features()).cast("long").alias("features"), F.sum("label").alias("positives"), (F.avg((F.col("predicted") == F.col("label")).cast("double")) > 0.99).alias("good"))


def _standard_prep(df: DataFrame) -> prep.Preprocessor:
    return prep.Preprocessor(["price", "qty", "flag"], ["cat_priority"], "y", ["is_active"], imputation="mean", scaling="none").fit(df)


_HOT_SQL = " ".join(f"union all select 'cat_priority={v}', sum((cat_priority = '{v}')::int)::double from test" for v in _PRIORITIES)


@query(f"""+ test as (select * from panel where year >= {TEST[0]} and year < {TEST[1]})
select 'price' as feature, round(sum(price), 2) as total from test
union all select 'qty', round(sum(coalesce(qty, (select avg(qty) from train))), 2) from test
union all select 'flag', round(sum(coalesce(flag, (select avg(flag) from train))), 2) from test
union all select 'is_active', sum(is_active::int)::double from test {_HOT_SQL}""")
def prep_fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir)
    train, _, test = panel.time_split(df, TRAIN, TEST)
    plan = _standard_prep(train)
    out = plan.transform(test)
    row = out.agg(*[F.round(F.sum(F.col(f"`{c}`")).cast("double"), 2).alias(c) for c in plan.names()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("total")) for c in plan.names()])))


@query("+ n as (select unnest(['price', 'qty', 'flag', 'is_active'] || (select list('cat_priority=' || p order by p) from (select distinct cat_priority as p from train))) as feature) select (row_number() over () - 1)::int as place, feature from n")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _standard_prep(training(spark, sf_dir)).names()
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")


@query(f"select (qty is null)::int as label, (qty is null)::int as predicted, count(*) as n, count(*) filter (dirty is null) as missing from {_FINITE} group by 1")
def trees_keep_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees learn, from features that keep their missing values, which orders have no quantity."""
    df = _finite(spark, sf_dir).withColumn("label", F.col("qty").isNull().cast("int")).withColumn("hidden", F.col("dirty").isNull())
    pipeline = experiments.Pipeline(prep.Preprocessor(["dirty", "qty"], [], "label", imputation="none", scaling="none"), models.Classifier("gbt", "label", params={"maxIter": 3, "maxDepth": 2}), [*KEYS, "hidden"])
    return pipeline.fit(df).predict(df).groupBy("label", "predicted").agg(F.count("*").alias("n"), F.count_if("hidden").alias("missing"))


# Metrics, curves, thresholds

_CONF = """+ c as (select count(*) as n, avg(y) as pos_rate, avg(p1) as mean_pred_p1, count(*) filter (p1 >= 0.5) as pred_pos, count(*) filter (y = 1) as pos,
  count(*) filter (p1 >= 0.5 and y = 1) as tp, avg((p1 - y) ** 2) as brier from panel)"""
_CONF_COLUMNS = """n, round(pos_rate, 6) as pos_rate, round(mean_pred_p1, 6) as mean_pred_p1, pred_pos, pos, tp,
  round(case when pred_pos > 0 then tp / pred_pos else 0 end, 6) as precision, round(case when pos > 0 then tp / pos else 0 end, 6) as recall,
  round(case when pos + pred_pos > 0 then 2 * tp / (pos + pred_pos) else 0 end, 6) as f1, round(brier, 6) as brier"""
_GROUPS = """g as (select p1 as threshold, count(*) as n, sum(y)::bigint as pos from panel group by p1),
  k as (select *, (sum(n) over (order by threshold desc))::bigint as pp, (sum(pos) over (order by threshold desc))::bigint as tp, (select sum(y) from panel)::double as p_all, (select count(*) - sum(y) from panel)::double as n_all from g)"""
_AUC = "round((select sum((n - pos) * (tp - pos / 2)) / max(p_all * n_all) from k), 6) as auc_roc, round((select sum(pos * (tp / pp)) / max(p_all) from k), 6) as average_precision"
_ROUNDED = ("pos_rate", "mean_pred_p1", "precision", "recall", "f1", "brier", "auc_roc", "average_precision")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    chosen = names or _ROUNDED
    return df.select(*[r6(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


@query(f"{_CONF} select {_CONF_COLUMNS} from c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.confusion_metrics(panel_of(spark, sf_dir), "y", "p1"))


@query(f"{_CONF}, {_GROUPS} select {_CONF_COLUMNS}, {_AUC} from c")
def metric_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.metric_row(panel_of(spark, sf_dir), "y", "p1"))


_LL = "-(y * ln(least(greatest(p1, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p1, 1e-15), 1 - 1e-15)))"


@query(f"""select round(avg((p1 - y) ** 2), 6) as brier, round(avg({_LL}), 6) as log_loss, round(sum((p1 - y) ** 2 * price) / sum(price), 6) as weighted_brier,
  round(sum(({_LL}) * price) / sum(price), 6) as weighted_log_loss from panel""")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.losses(panel_of(spark, sf_dir), "y", "p1", "price"), "brier", "log_loss", "weighted_brier", "weighted_log_loss")


@query(f"+ {_GROUPS} select {_AUC}")
def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(curves.auc(panel_of(spark, sf_dir), "y", "p1"))


@query(f"+ {_GROUPS} select 'Infinity'::double as threshold, 0.0::double as fpr, 0.0::double as tpr union all select threshold, round((pp - tp) / n_all, 6), round(tp / p_all, 6) from k")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(curves.roc_curve(panel_of(spark, sf_dir), "y", "p1"), "fpr", "tpr")


@query(f"+ {_GROUPS} select threshold, round(tp / pp, 6) as precision, round(tp / p_all, 6) as recall from k")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(curves.pr_curve(panel_of(spark, sf_dir), "y", "p1"))


@query(f"""+ {_GROUPS}, s as (select tp / p_all as r, tp / pp as p, coalesce(lag(tp / p_all) over (order by threshold desc), 0) as r0, coalesce(lag(tp / pp) over (order by threshold desc), tp / pp) as p0 from k)
select round(sum((r - r0) * (p + p0) / 2), 6) as pr_area from s""")
def pr_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(curves.pr_trapezoid(panel_of(spark, sf_dir), "y", "p1"), "pr_area")


_SWEEP = """w as (select i::int as i, i / 99.0::double as threshold, count(*) filter (p1 >= i / 99.0::double and y = 1) as tp, count(*) filter (p1 >= i / 99.0::double and y = 0) as fp,
  count(*) filter (p1 < i / 99.0::double and y = 1) as fn, count(*) filter (p1 < i / 99.0::double and y = 0) as tn from range(100) t(i), panel group by i)"""


@query(f"+ {_SWEEP} select * from w")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.sweep(panel_of(spark, sf_dir), "y", "p1")


def _tuned(name: str, value: str, run: Callable[[DataFrame], DataFrame]) -> None:
    @query(f"+ {_SWEEP} select threshold, round({value}, 6) as value from w order by {value} desc, threshold limit 1", name)
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(run(panel_of(spark, sf_dir)), "value")


_tuned("tune_f1", "(2 * tp / (2 * tp + fp + fn))", lambda df: threshold.tune_f(df, "y", "p1"))
_tuned("tune_f2", "(5 * tp / (5 * tp + 4 * fn + fp))", lambda df: threshold.tune_f(df, "y", "p1", beta=2.0))
_tuned("tune_custom", "((tp + tn) / (tp + fp + fn + tn))", lambda df: threshold.tune_custom(df, "y", "p1", lambda tp, fp, fn, tn: (tp + tn) / (tp + fp + fn + tn)))


@query(f"+ {_GROUPS} select least(threshold, 1.0::double) as threshold, value from (select threshold, round(tp / p_all - (pp - tp) / n_all, 12) as value from k union all select 1.0, 0.0) order by value desc, threshold desc limit 1")
def tune_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.tune_youden(panel_of(spark, sf_dir), "y", "p1")


@query(f"""+ {_GROUPS}, f as (select threshold, 2 * tp / (pp + p_all) as value from k where tp / pp >= 0.3 and tp / p_all >= 0.2)
select coalesce((select threshold from f order by round(value, 12) desc, threshold desc limit 1), 0.5::double) as threshold, round(coalesce((select max(value) from f), 0.0), 6) as value, (select count(*) > 0 from f) as feasible""")
def tune_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(threshold.tune_constrained(panel_of(spark, sf_dir), "y", "p1", 0.3, 0.2), "value")


@query("""+ r as (select customer_id, 2.0 ** coalesce(n_lines, 0) - 1 as gain, row_number() over (partition by customer_id order by p1 desc, sid) as pos_at,
  row_number() over (partition by customer_id order by n_lines desc nulls last, sid) as best from panel)
select customer_id, round(case when sum(gain / log2(1 + best)) > 0 then sum(gain / log2(1 + pos_at)) / sum(gain / log2(1 + best)) else 1.0 end, 6) as ndcg from r group by customer_id""")
def ndcg_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ndcg(panel_of(spark, sf_dir), "customer_id", "n_lines", "p1", KEYS), "ndcg")


@query("select case when count(*) filter (y not in (0, 1)) = 0 and count(*) filter (p1 < 0 or p1 > 1) = 0 then 'ok' else 'bad' end as scores, 'bad' as prices, count(*) as n from panel")
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores pass the checks of a threshold's inputs; prices, far above 1, don't."""
    df = panel_of(spark, sf_dir)

    def said(column: str) -> str:
        try:
            threshold.check_inputs(df, "y", column)
        except ValueError:
            return "bad"
        return "ok"

    return df.agg(F.lit(said("p1")).alias("scores"), F.lit(said("price")).alias("prices"), F.count("*").alias("n"))


# Models


@query("select a.customer_id, a.sid as sid_more, b.sid as sid_less, round(a.price - b.price, 6) as price from panel a join panel b on a.customer_id = b.customer_id and a.n_lines > b.n_lines")
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.pairs(panel_of(spark, sf_dir), "customer_id", "n_lines", KEYS, ["price"]), "price")


_NUMERIC, _CATEGORICAL = ["price", "balance", "n_lines", "qty"], ["cat_priority", "cat_segment"]


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a label that the price decides."""
    return panel_of(spark, sf_dir).withColumn("label", (F.col("price") > 300_000).cast("int"))


def _scored(kind: str, params: dict, early: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, valid, test = panel.time_split(_planted(spark, sf_dir), TRAIN, TEST, VALID)
        pipeline = experiments.Pipeline(prep.Preprocessor(_NUMERIC, _CATEGORICAL, "label"), models.Classifier(kind, "label", params=params), KEYS)
        pipeline.fit(train, valid if early else None)
        return pipeline.predict(test).select("sid", "label", "p1", "predicted")

    return run


QUERIES["lr_scores"] = _scored("lr", {})
QUERIES["rf_scores"] = _scored("rf", {"numTrees": 20, "maxDepth": 6})
QUERIES["gbt_scores"] = _scored("gbt", {"maxIter": 10, "maxDepth": 3})
QUERIES["boosted_early_stop"] = _scored("gbt", {"maxIter": 20, "maxDepth": 3, "validationTol": 0.01}, early=True)
QUERIES["mlp_scores"] = _scored("mlp", {"hidden": [8], "maxIter": 30})


@query()
def pca_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    df = panel_of(spark, sf_dir)
    vectors = prep.Preprocessor(_NUMERIC, _CATEGORICAL, "y").fit(df).assemble(df, keep=KEYS)
    return prep.pca(vectors, 3, keep=KEYS).select("sid", vector_to_array("components").alias("components"))


@query()
def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel_of(spark, sf_dir).withColumn("qty", F.coalesce("qty", F.lit(0.0))).withColumn("price", F.col("price") / 100_000)
    return models.LinearRanker("customer_id", "n_lines", KEYS, ["qty", "price"]).fit(df).predict(df).select("sid", "score")


@query("select count(*) as n, true as better, true as good from panel")
def ranker_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which price is relevant depends on the customer's balance: trees find out, a linear score can't."""
    df = panel_of(spark, sf_dir).withColumn("wanted", ((F.col("price") > 150_000) == (F.col("balance") > 4_000)).cast("int")).withColumn("scaled", F.col("price") / 100_000)
    linear = models.LinearRanker("customer_id", "wanted", KEYS, ["scaled", "balance"]).fit(df.withColumn("balance", F.col("balance") / 10_000))
    boosted = ranker.BoostedRanker("customer_id", "wanted", ["price", "balance"], rounds=8, depth=3).fit(df)
    found = [metrics.ndcg(m.predict(df), "customer_id", "wanted", "score", KEYS).agg(F.avg("ndcg")).first()[0] for m in (linear, boosted)]
    return df.agg(F.count("*").alias("n"), F.lit(found[1] > found[0]).alias("better"), F.lit(found[1] > 0.95).alias("good"))


@query()
def mined_by_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"final": {"strategy": "hard_negative", "features": ["price", "balance"], "ratio": 0.5}}
    return sampling.for_mode(training(spark, sf_dir), "y_rare", KEYS, config, "final").select("sid", "y_rare")


def _forest(label: str):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol=label, numTrees=5, maxDepth=3, seed=1)


@query(f"select 'positive' as part, count(*) as n from train where y_rare = 1 union all select 'negative', least(greatest(floor({_POS} / 0.5), 100), {_NEG})::bigint")
def mined_by_own_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's estimator comes from a factory; how many rows are mined doesn't depend on it."""
    df = training(spark, sf_dir)
    found = mining.baseline_scores(df, "y_rare", KEYS, ["price", "balance"], estimator=_forest)
    mined = mining.hard_negatives(df, "y_rare", KEYS, found, ratio=0.5)
    return mined.groupBy(F.when(F.col("y_rare") == 1, "positive").otherwise("negative").alias("part")).agg(F.count("*").alias("n"))


_FACTS_SQL = f"""select '{{kind}}' as kind, count(*) as n, count(*) filter (price > 300000) as positives, true as in_range, true as by_threshold, true as good
  from panel where year >= {TEST[0]} and year < {TEST[1]}"""


def _facts(kind: str, params: dict, early: bool = False) -> None:
    """What must hold of any good model of the planted label: rows, ranges, decisions, AUC above 0.9."""
    name = f"{'early' if early else kind}_facts"

    @query(_FACTS_SQL.format(kind=kind), name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = _scored(kind, params, early)(spark, sf_dir)
        auc = curves.auc(scored, "label", "p1").first()["auc_roc"]
        return scored.agg(
            F.lit(kind).alias("kind"),
            F.count("*").alias("n"),
            F.count_if(F.col("label") == 1).alias("positives"),
            F.min(F.col("p1").between(0, 1)).alias("in_range"),
            F.min((F.col("p1") >= 0.5).cast("int") == F.col("predicted")).alias("by_threshold"),
            F.lit(auc > 0.9).alias("good"),
        )


for _kind, _params, _early in (("lr", {}, False), ("rf", {"numTrees": 10, "maxDepth": 5}, False), ("gbt", {"maxIter": 5, "maxDepth": 3}, False), ("gbt", {"maxIter": 10, "maxDepth": 3, "validationTol": 0.01}, True), ("mlp", {"hidden": [8], "maxIter": 60}, False)):
    _facts(_kind, _params, _early)


@query("select unnest(['intercept', 'iterations', 'train_accuracy', 'train_auc']) as name, true as plausible")
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = experiments.quick_train(_planted(spark, sf_dir), _NUMERIC, _CATEGORICAL, "label", "lr", KEYS).classifier.report(spark)
    return report.select("name", (F.when(F.col("name").startswith("train"), F.col("value").between(0.9, 1.0)).otherwise(~F.isnan("value"))).alias("plausible"))


@query()
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _planted(spark, sf_dir)
    return experiments.quick_train(df, _NUMERIC, _CATEGORICAL, "label", "rf", KEYS, numTrees=20, maxDepth=6).classifier.importances(spark)


@query()
def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.quick_train(_planted(spark, sf_dir), _NUMERIC, _CATEGORICAL, "label", "lr", KEYS).classifier.training_history(spark)


@query("select part, true as falls, true as finite, true as as_long from (values ('train'), ('valid')) t(part)")
def history_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss curves of the perceptron on training and validation rows, one point of each an epoch."""
    train, valid, _ = panel.time_split(_planted(spark, sf_dir), TRAIN, TEST, VALID)
    fitted = experiments.Pipeline(prep.Preprocessor(_NUMERIC, _CATEGORICAL, "label"), models.Classifier("mlp", "label", params={"hidden": [8], "maxIter": 12}), KEYS).fit(train, valid)
    curves_of = fitted.classifier.training_history(spark)
    ends = curves_of.groupBy("part").agg(F.min_by("loss", "iteration").alias("first"), F.max_by("loss", "iteration").alias("last"), F.count("*").alias("n"), F.min(F.abs("loss") < float("inf")).alias("finite"))
    return ends.select("part", (F.col("last") < F.col("first")).alias("falls"), "finite", (F.col("n") == len(fitted.classifier.history["train"])).alias("as_long"))


@query()
def pipeline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid, test = panel.time_split(_planted(spark, sf_dir), TRAIN, TEST, VALID)
    pipeline = experiments.Pipeline(prep.Preprocessor(_NUMERIC, _CATEGORICAL, "label"), models.Classifier("lr", "label"), KEYS).fit(train, valid, "f1")
    path = scratch_path(spark, "pipeline")
    pipeline.save(spark, path)
    return experiments.Pipeline.load(spark, path).predict(test).select("sid", "p1", "predicted")


def _grid(spark: SparkSession, sf_dir: str, overrides: list[dict] | None = None, log: str | None = None) -> DataFrame:
    data = {"train": TRAIN, "valid": VALID, "test": TEST}
    sampled = {"tune": {"strategy": "undersample", "ratio": 0.5}}
    lists = {"numeric": _NUMERIC, "categorical": _CATEGORICAL}
    runs = [{"name": n, "data": data, "sampling": s, "prep": lists, "weight_cap": w, "model": {"kind": "lr", "params": {"maxIter": 30}}} for n, s, w in (("plain", {}, None), ("balanced", sampled, 50.0))]
    return experiments.run_experiments(_planted(spark, sf_dir), "label", KEYS, runs, overrides, log=log)


@query("select name || o as run_name, 1::bigint as records, true as complete from (values ('balanced'), ('plain')) r(name), (values ('|regParam=0.01'), ('|regParam=0.1')) v(o)")
def rerun_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid that is run again, and logged once more, leaves one record of each run."""
    path, some = scratch_path(spark, "runs"), [{"regParam": 0.01}, {"regParam": 0.1}]
    experiments.log_runs(_grid(spark, sf_dir, some[:1], path), path)
    table = _grid(spark, sf_dir, some, path)
    one = table.groupBy("run_name", "kind", "key").count().groupBy("run_name").agg(F.max("count").alias("records"), F.count_if(F.col("key") == "test_auc_roc").alias("n"))
    return one.select("run_name", "records", (F.col("n") == 1).alias("complete"))


@query()
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, [{"regParam": 0.01}, {"regParam": 0.1}])


@query()
def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    experiments.log_runs(_grid(spark, sf_dir), path)
    return experiments.read_runs(spark, path)


@query()
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.leaderboard(_grid(spark, sf_dir))


@query(f"select 'tune' as run_name, sid, y_rare from train where {_UNDER}")
def prepared_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [{"name": "tune", "data": {"train": TRAIN, "test": TEST}, "sampling": {"tune": {"strategy": "undersample", "ratio": 0.5}}}]
    return experiments.run_experiments(panel_of(spark, sf_dir), "y_rare", KEYS, runs, fit=False).select("run_name", "sid", "y_rare")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
