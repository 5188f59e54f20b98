"""Building all layers in order, with tests before the marts are published."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession

from martloom.functions.casts import LENIENT
from martloom.operators.checks import derive_tests
from martloom.operators.summaries import summarise_for, test_results
from martloom.plans.models import (
    build_enriched,
    build_mart,
    build_staging,
    enriched_name,
    mart_name,
    register_staging,
    staging_name,
    write_mart,
)
from martloom.session import counts_of, run_together
from martloom.spec import Relationship, TableSpec

OK, FAILED, SKIPPED = "ok", "error", "skipped"


@dataclass(frozen=True)
class Step:
    step: str
    model: str
    rows: int | None
    status: str
    reason: str


def build_all(
    spark: SparkSession,
    specs: Sequence[TableSpec],
    frames: dict[str, DataFrame],
    relationships: Sequence[Relationship],
    root: str,
    mode: str = LENIENT,
) -> list[Step]:
    """Staging views, tests on them, then the mart and enriched tables whose tests pass.

    Each table is scanned once for all its tests and once for its mart, whose rows are counted as they are
    written; enriched tables read the published marts.

    A model whose own tests, or those of a model it points at, fail is skipped, and what was
    published of it before stays. Otherwise the build stops at the first failing layer. Models
    of one layer do not depend on each other and are built at the same time.
    """
    by_name = {spec.name: spec for spec in specs}
    staging: dict[str, DataFrame] = {}

    def stage_view(spec: TableSpec) -> None:
        staging[spec.name] = register_staging(build_staging(frames[spec.name], spec, mode), spec.name)

    published: dict[str, DataFrame] = {}

    def mart(name: str) -> int:
        seen = Observation()
        published[name] = write_mart(spark, build_mart(staging[name]), mart_name(name), root, seen)
        return counts_of(seen, "rows")["rows"]

    def enriched(child: str) -> int:
        seen = Observation()
        model = build_enriched(by_name[child], relationships, by_name, published)  # those of blocked models are blocked too
        write_mart(spark, model, enriched_name(child), root, seen)
        return counts_of(seen, "rows")["rows"]

    steps = run_together([partial(_step, "staging", staging_name(spec.name), partial(stage_view, spec)) for spec in specs])
    if not succeeded(steps):
        return steps
    tests, failing = run_test_steps(specs, relationships, staging)
    steps += tests
    blocked = blocked_models(failing, relationships)
    children = list(dict.fromkeys(r.child_table for r in relationships))
    layers = [("mart", mart_name, mart, [spec.name for spec in specs]), ("enriched", enriched_name, enriched, children)]
    for layer, named, build, tables in layers:
        built = run_together([partial(_step, layer, named(t), partial(build, t)) for t in tables if t not in blocked])
        done = {s.model: s for s in built}
        steps += [done.get(named(t)) or Step(layer, named(t), None, SKIPPED, f"tests failed: {blocked[t]}") for t in tables]
        if not succeeded(built):
            return steps
    return steps


def blocked_models(failing: Sequence[str], relationships: Sequence[Relationship]) -> dict[str, str]:
    """Tables that must not be published, with the failing tables they are or point at."""
    causes = {name: {name} for name in failing}
    grown = True
    while grown:
        grown = False
        for r in relationships:
            more = causes.get(r.parent_table, set()) - causes.get(r.child_table, set())
            if more:
                causes.setdefault(r.child_table, set()).update(more)
                grown = True
    return {name: ", ".join(sorted(found)) for name, found in causes.items()}


def _step(step: str, model: str, action: Callable[[], int | None]) -> Step:
    try:
        return Step(step, model, action(), OK, "")
    except (PySparkException, ValueError, KeyError) as error:
        return Step(step, model, None, FAILED, str(error).split("\n")[0])


def run_test_steps(
    specs: Sequence[TableSpec], relationships: Sequence[Relationship], staging: dict[str, DataFrame]
) -> tuple[list[Step], list[str]]:
    """One step per derived test, whose rows are its failures, and the tables with a failing test."""
    tests = derive_tests(specs, relationships)
    if not tests:
        return [], []
    rows = test_results(tests, summarise_for(tests, staging), SparkSession.active()).orderBy("model", "test", "column").collect()
    steps = [
        Step(
            "test",
            f"{r['test']} {r['model']}.{r['column']}",
            r["failures"],
            OK if r["status"] == "pass" else FAILED,
            "" if r["status"] == "pass" else f"{r['failures']} failures",
        )
        for r in rows
    ]
    bad = {r["model"] for r in rows if r["status"] != "pass"}
    return steps, [spec.name for spec in specs if f"stg_{spec.name}" in bad]


def step_frame(steps: Sequence[Step], spark: SparkSession) -> DataFrame:
    rows = [(s.step, s.model, s.rows, s.status, s.reason) for s in steps]
    return spark.createDataFrame(rows, "step string, model string, rows bigint, status string, reason string")


def succeeded(steps: Sequence[Step]) -> bool:
    return all(s.status == OK for s in steps)


def drop_staging(spark: SparkSession, specs: Sequence[TableSpec]) -> None:
    for spec in specs:
        spark.catalog.dropTempView(staging_name(spec.name))

