"""Counts, summaries and the layered build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.operators.inspection import inspect, table_counts, table_summary
from martloom.plans.build import build_all, step_frame
from martloom.plans.models import build_layers
from martloom.session import scratch_path
from registry.checking import DEFECTIVE_SQL, defective, run_tests_sql
from registry.model import RELATIONSHIPS, SPECS, staged_sql, target, target_sql, targets

LAYERS = {"stg_": "dbt staging", "mart_": "dbt mart"}
CHILDREN = list(dict.fromkeys(r.child_table for r in RELATIONSHIPS))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loaded table, staging view and mart."""
    frames = targets(spark, sf_dir)
    return table_counts(frames | build_layers(list(SPECS.values()), frames, RELATIONSHIPS))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User tables only: the generated models are left out by name."""
    frames = targets(spark, sf_dir)
    every = table_summary(frames | {f"stg_{n}": df for n, df in frames.items()} | {"martial": frames["region"]})
    return every.select("table", "rows", F.array_join("columns", ", ").alias("columns"))


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(target(spark, sf_dir, "order"), ["order_id"])


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = build_all(spark, list(SPECS.values()), targets(spark, sf_dir), RELATIONSHIPS, scratch_path(spark, "marts"))
    return step_frame(steps, spark)


def build_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with defects: models whose tests fail, and those that point at them, are not published."""
    steps = build_all(spark, list(SPECS.values()), defective(spark, sf_dir), RELATIONSHIPS, scratch_path(spark, "marts"))
    return step_frame(steps, spark)


QUERIES = {"table_counts": counts, "table_summary": summary, "inspect_limit": first_orders, "build_all": build, "build_gated": build_gated}


def _count_sql(layer: str, name: str, relation: str) -> str:
    return f"select '{layer}' as layer, '{name}' as table_name, count(*) as row_count from ({relation})"


def _counts_sql() -> str:
    parts = [_count_sql("loaded/source", n, target_sql(n)) for n in SPECS]
    parts += [_count_sql(layer, prefix + n, staged_sql(n)) for prefix, layer in LAYERS.items() for n in SPECS]
    parts += [_count_sql("dbt mart", f"mart_{n}_enriched", staged_sql(n)) for n in CHILDREN]
    return " union all ".join(parts)


def _summary_sql() -> str:
    names = {n: SPECS[n] for n in SPECS} | {"martial": SPECS["region"]}
    return " union all ".join(
        f"select '{n}' as \"table\", count(*) as rows, '{', '.join(spec.column_names)}' as columns from ({target_sql(spec.name)})"
        for n, spec in names.items()
    )


def _build_sql(views: dict[str, str]) -> str:
    links = ", ".join(f"('{r.child_table}', '{r.parent_table}')" for r in RELATIONSHIPS)
    parts = [
        f"select 'staging' as step, 'stg_{n}' as model, cast(null as bigint) as rows, 'ok' as status, '' as reason"
        for n in SPECS
    ]
    parts.append(
        "select 'test', test || ' ' || model || '.' || \"column\", failures, case when failures = 0 then 'ok' else 'error' end, "
        "case when failures = 0 then '' else failures || ' failures' end from tests"
    )
    models = [("mart", n, f"mart_{n}") for n in SPECS] + [("enriched", n, f"mart_{n}_enriched") for n in CHILDREN]
    parts += [
        f"select '{step}', '{model}', case when c.t is null then n.rows end, case when c.t is null then 'ok' else 'skipped' end, "
        f"coalesce('tests failed: ' || c.causes, '') from (select count(*) as rows from ({views[n]})) n left join causes c on c.t = '{n}'"
        for step, n, model in models
    ]
    return f"""
        with recursive links(child, parent) as (values {links}),
        tests as ({run_tests_sql(views)}),
        blocked(t, cause) as (
            select distinct model[5:], model[5:] from tests where failures > 0
            union select child, cause from links join blocked on t = parent),
        causes as (select t, string_agg(distinct cause, ', ' order by cause) as causes from blocked group by t)
        {' union all '.join(parts)}"""


ORACLES = {
    "table_counts": _counts_sql(),
    "table_summary": _summary_sql(),
    "build_all": _build_sql({n: target_sql(n) for n in SPECS}),
    "build_gated": _build_sql(DEFECTIVE_SQL),
    "inspect_limit": f"{target_sql('order')} order by o_orderkey limit 100",
}
