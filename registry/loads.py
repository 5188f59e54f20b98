"""Loading: recreate, several files, file acceptance, quarantine, upsert, keys, evolution, reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.functions.names import table_name
from martloom.operators.discovery import extend_schema, infer_relationships, propose_schema, schema_specs
from martloom.operators.inspection import table_counts
from martloom.operators.keys import generate_keys, last_wins
from martloom.operators.loading import (
    FILE,
    NO_MAPPING,
    ROW,
    accepted_rows,
    file_statuses,
    fit_rows,
    quarantine,
    status_frame,
    total_rows,
    union_files,
)
from martloom.operators.mapping import Mapping
from martloom.operators.profiling import profile_all
from martloom.plans.migrate import Source, migrate
from martloom.plans.models import build_enriched, build_staging
from martloom.session import scratch_path, stage
from martloom.sources.raw import ROW_NUMBER, SOURCE_FILE, RawTable, land_all, land_raw, raw_counts
from martloom.sources.store import TableStore
from martloom.spec import TableSpec, table
from registry.model import SPECS, given, target, write_source

BUCKETS = 8
ORDER = SPECS["order"]
# The same table without NOT NULL columns, for batches that leave columns out.
LOOSE_ORDER = table(
    "order", [(c.name, c.sql_type) for c in ORDER.columns], "order_id", foreign_keys={"customer_id": ("customer", "customer_id")}
)
PAGE = table("page", "page_id INTEGER, url TEXT, batch INTEGER", "page_id")
# Pages in a file of the source with very many files.
FILE_PAGES = 25
COLUMNS_SQL = "o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, o_totalprice as price"
STORED_SQL = COLUMNS_SQL + ", cast(o_orderdate as varchar) as order_date"


def store(spark: SparkSession, buckets: int | None = None) -> TableStore:
    return TableStore(spark, scratch_path(spark, "store"), buckets)


def as_file(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns({FILE: F.lit(name), ROW: F.col("order_id")})


def load_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text values become the declared types; a second load replaces the first."""
    orders = target(spark, sf_dir, "order")
    texts = orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])
    tables = store(spark)
    tables.write(ORDER, fit_rows(orders.withColumn("price", F.lit(0)), ORDER))
    return tables.write(ORDER, fit_rows(texts, ORDER))


def load_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of one table; the second has no price, the third columns in another order."""
    orders = target(spark, sf_dir, "order")
    files = [
        orders.where("status = 'F'"),
        orders.where("status = 'O'").drop("price"),
        orders.where("status = 'P'").select("order_date", "price", "status", "customer_id", "order_id"),
    ]
    batch = union_files([as_file(df, f"orders_{i}.csv") for i, df in enumerate(files)])
    return store(spark).write(ORDER, fit_rows(batch, ORDER))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six files: c and f load, d repeats keys of c, e lacks customers, f shares keys with d only."""
    orders = target(spark, sf_dir, "order")
    pending = orders.where("status = 'P'")
    shifted = pending.withColumn("order_id", -1 - F.col("order_id"))
    files = {
        "a.csv": orders.where("status = 'F'"),
        "b.csv": orders.where("status = 'O'"),
        "c.csv": pending,
        "d.csv": pending.withColumn("price", F.col("price") + 1).unionByName(shifted),
        "e.csv": orders.where("status = 'F'").withColumns(
            {"order_id": F.col("order_id") + 1000000000, "customer_id": F.lit(None).cast("bigint")}
        ),
        "f.csv": shifted.withColumn("price", F.col("price") + 2),
    }
    return fit_rows(union_files([as_file(df, name) for name, df in files.items()]), ORDER)


def load_file_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = order_files(spark, sf_dir)
    return store(spark).write(ORDER, accepted_rows(batch, file_statuses(batch, ORDER), ORDER))


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as written and read back."""
    statuses = file_statuses(order_files(spark, sf_dir), ORDER)
    path = scratch_path(spark, "report")
    report = status_frame(statuses, spark)
    report.write.json(path)
    return spark.read.schema(report.schema).json(path)


def load_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_rows(load_report(spark, sf_dir))


def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = quarantine(order_files(spark, sf_dir), ORDER)
    return bad.unionByName(good.withColumn("reason", F.lit("good"))).withColumnRenamed(FILE, "source_file").drop(ROW)


def load_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders change price and lose their unmapped columns; new keys are added."""
    tables = store(spark, BUCKETS)
    orders = target(spark, sf_dir, "order")
    tables.write(LOOSE_ORDER, fit_rows(orders, LOOSE_ORDER))
    urgent = given(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    changed = urgent.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_totalprice") + 1).alias("price")
    )
    added = changed.withColumn("order_id", -1 - F.col("order_id"))
    return tables.upsert(LOOSE_ORDER, fit_rows(changed.unionByName(added), LOOSE_ORDER))


def upsert_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order changes: the table as stored, with the number of buckets that the upsert wrote."""
    tables = store(spark, BUCKETS)
    orders = target(spark, sf_dir, "order")
    tables.write(LOOSE_ORDER, fit_rows(orders, LOOSE_ORDER))
    before = set(tables.parts("order").folders())
    dearest = orders.orderBy(F.col("price").desc(), "order_id").limit(1).withColumn("price", F.col("price") + 1)
    stored = tables.upsert(LOOSE_ORDER, fit_rows(dearest, LOOSE_ORDER))
    written = set(tables.parts("order").folders()) - before
    return stored.withColumn("buckets_written", F.lit(len(written)))


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeat (order, line number); the last by ship date, product and price stays."""
    lines = given(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice", "l_quantity"
    )
    return last_wins(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice", "l_quantity"])


def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment lost their key and get new ones in name order."""
    customers = target(spark, sf_dir, "customer").withColumn(
        "customer_id", F.when(F.col("segment") != "MACHINERY", F.col("customer_id"))
    )
    return generate_keys(customers, "customer_id", order=["full_name"])


def evolve_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first batch without balance, then one with it: the column is added, old rows stay NULL."""
    tables = store(spark)
    customers = target(spark, sf_dir, "customer")
    old = table("customer", "customer_id INTEGER, full_name TEXT, segment TEXT", "customer_id")
    new = table("customer", "customer_id INTEGER, full_name TEXT, segment TEXT, balance REAL", "customer_id")
    tables.write(old, fit_rows(customers.where("segment = 'BUILDING'"), old))
    return tables.upsert(new, fit_rows(customers.where("segment <> 'BUILDING'"), new))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, RawTable]:
    names = ("customer", "orders", "part")
    paths = [write_source(given(spark, sf_dir, name), name, "csv") for name in names]
    landed = land_all(spark, paths, scratch_path(spark, "raw"), "2024-01-01T00:00:00+00:00")
    return dict(zip(names, landed))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows landed per source, over its part files."""
    counts = raw_counts(list(raw_tables(spark, sf_dir).values()))
    return counts.groupBy("table").agg(F.sum("rows").alias("rows"))


CUSTOMER_MAP = [
    ("customer_id", "c_custkey"), ("full_name", "c_name"), ("segment", "c_mktsegment"), ("nation_id", "c_nationkey"),
]
ORDER_MAP = [
    ("order_id", "o_orderkey"), ("customer_id", "o_custkey"), ("status", "o_orderstatus"), ("order_date", "o_orderdate"),
]
MAPPINGS = [
    Mapping(spec, column, f"{source}.csv", given_name)
    for spec, source, columns in (
        ("customer", "customer", CUSTOMER_MAP),
        (
            "order",
            "orders",
            ORDER_MAP,
        ),
        ("product", "part", [("product_id", "p_partkey"), ("brand", "p_brand"), ("price", "p_retailprice")]),
    )
    for column, given_name in columns
] + [Mapping("product", "product_name", "part.csv", "p_name", "upper(p_name)")]
MIGRATED: list[TableSpec] = [
    SPECS["customer"],
    SPECS["order"],
    SPECS["product"],
    table("brand", "brand_id INTEGER, name TEXT", "brand_id"),
]


def raw_sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    return [
        Source(f"{name}.csv", landed.read(), "_raw_row_number", file="_source_file")
        for name, landed in raw_tables(spark, sf_dir).items()
    ]


def migrate_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only products are selected: the other targets are there, and empty."""
    tables = store(spark)
    migrate(spark, MIGRATED, raw_sources(spark, sf_dir), MAPPINGS, tables, tables=["product", "unknown"])
    return table_counts({name: tables.read(name) for name in tables.tables()}).drop("layer")


def migrate_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into the project store: the second replaces what the first left by key."""
    project, sources = store(spark, BUCKETS), raw_sources(spark, sf_dir)
    specs = [SPECS["customer"]]
    migrate(spark, specs, sources, MAPPINGS, store(spark), project)
    again = [replace(m, transformation="upper(c_mktsegment)") if m.target_column == "segment" else m for m in MAPPINGS]
    shouting = [m for m in again if m.target_column != "full_name"]
    migrate(spark, specs, sources, shouting, store(spark), project)
    return project.read("customer")


def migrate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as CSV, landed raw, mapped, loaded into both stores, validated.

    Customers refer to nations, which are not a target here, so every reference is a violation.
    """
    sources = raw_sources(spark, sf_dir)
    mappings = [*MAPPINGS, Mapping("brand", "name", "part.csv", "p_brand")]
    done = migrate(
        spark, MIGRATED, sources, mappings, store(spark), store(spark, BUCKETS), report_path=scratch_path(spark, "report")
    )
    return done.validation


def load_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of many files, many of which repeat a key of the file before: landed, loaded by file, read from the store.

    A file that shares a key with an accepted one is rejected whole, so one that shares a key with a rejected one is not.
    """
    batch = F.floor(F.col("page_id") / FILE_PAGES)
    pages = given(spark, sf_dir, "pages").select("page_id", "url", batch.alias("batch"))
    first = pages.where((F.col("page_id") % FILE_PAGES == 0) & (F.length("url") % 3 != 0))
    again = first.select("page_id", F.concat("url", F.lit("#again")).alias("url"), (F.col("batch") + 1).alias("batch"))
    named = pages.unionByName(again).withColumn("file", F.lpad(F.col("batch").cast("string"), 12, "0"))
    path = f"{scratch_path(spark, 'source')}/source1_pages.csv"
    named.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    source = Source("source1_pages.csv", land_raw(spark, path, scratch_path(spark, "raw"), "2024-01-01T00:00:00+00:00").read(), ROW_NUMBER, file=SOURCE_FILE)
    tables = store(spark)
    migrate(spark, [PAGE], [source], [Mapping("page", c.name, source.name, c.name) for c in PAGE.columns], tables)
    return tables.read("page")


def load_report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source in many files, one of which has only empty rows: every file is reported."""
    filled = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey"))
    rows = given(spark, sf_dir, "customer").select("c_custkey", filled.alias("id"), F.col("c_mktsegment").alias("file"))
    source = Source("customers.csv", rows, "c_custkey", file="file")
    specs, mappings = [table("client", "client_id INTEGER", "client_id")], [Mapping("client", "client_id", "customers.csv", "id")]
    return migrate(spark, specs, [source], mappings, store(spark)).report


def migrate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five parts of a run's report, read back as they were written (but for the time of the run)."""
    path = scratch_path(spark, "report")
    sources = [Source(f"{n}.csv", given(spark, sf_dir, n), order) for n, order in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))]
    migrate(spark, MIGRATED, sources, MAPPINGS, store(spark), report_path=path)

    def part(name: str, schema: str, *values) -> DataFrame:
        said = [F.coalesce(F.expr(v).cast("string"), F.lit("")).alias(c) for c, v in zip("abcd", values, strict=True)]
        return spark.read.schema(schema).json(f"{path}/{name}").select(F.lit(name).alias("part"), *said)

    listed = ("run", "timestamp string, source_files array<string>, selected_tables array<string>", "array_join(source_files, ' ')",
              "array_join(selected_tables, ' ')", "timestamp is not null", "''")
    loaded = ("rows_loaded", "`table` string, source_file string, rows long, status string, reason string", "`table`", "source_file",
              "rows", "concat_ws(': ', status, nullif(reason, ''))")
    mapped = ("mappings", "target_table string, target_column string, source_file string, source_column string, transformation string",
              "target_table", "target_column", "concat_ws('.', source_file, source_column)", "transformation")
    columns = ("target_columns", "`table` string, column string, sql_type string, primary_key boolean", "`table`", "column", "sql_type", "primary_key")
    checked = ("validation", "`table` string, row_count long, fk_violations long, status string", "`table`", "row_count", "fk_violations", "status")
    first, *rest = (part(*p) for p in (listed, loaded, mapped, columns, checked))
    for df in rest:
        first = first.unionByName(df)
    return first


def extend_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored project meets new sources: their schema is proposed, the stored specs are extended, rows
    are upserted, and orders are modelled from the specs as stored."""
    project = store(spark, BUCKETS)
    first = table("order", "order_id INTEGER, customer_id INTEGER, price REAL", "order_id")
    project.write(first, fit_rows(target(spark, sf_dir, "order"), first))
    opened = given(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        (F.col("o_totalprice") + 1).alias("price"), F.col("o_orderpriority").alias("priority"),
    )
    customers = given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    frames = {"source2_order.csv": opened, "source2_customer.csv": customers}
    proposed = schema_specs(propose_schema(stage(profile_all(frames), "catalog")))
    new = {table_name(name): df for name, df in frames.items()}
    for spec in extend_schema(project.specs(), proposed):
        project.upsert(spec, fit_rows(new[spec.name], spec))
    specs = {spec.name: spec for spec in project.specs()}
    staging = {name: build_staging(project.read(name), spec) for name, spec in specs.items()}
    return build_enriched(specs["order"], infer_relationships(list(specs.values())), specs, staging)


QUERIES = {
    "load_recreate": load_recreate,
    "load_multi_file": load_multi_file,
    "load_file_atomic": load_file_atomic,
    "load_contested": load_contested,
    "load_report": load_report,
    "load_report_parts": load_report_parts,
    "load_total": load_total,
    "quarantine_rows": quarantine_rows,
    "load_upsert": load_upsert,
    "upsert_touched": upsert_touched,
    "upsert_last_wins": upsert_last_wins,
    "surrogate_key": surrogate_key,
    "evolve_columns": evolve_columns,
    "raw_counts": raw_rows,
    "migrate_all": migrate_all,
    "migrate_selected": migrate_selected,
    "migrate_project": migrate_project,
    "migrate_report": migrate_report,
    "extend_project": extend_project,
}

FILES_SQL = f"""
    with o as (select {STORED_SQL} from orders),
    files as (
        select 'a.csv' as source_file, * from o where status = 'F'
        union all select 'b.csv', * from o where status = 'O'
        union all select 'c.csv', * from o where status = 'P'
        union all select 'd.csv', * replace (price + 1 as price) from o where status = 'P'
        union all select 'd.csv', * replace (-1 - order_id as order_id) from o where status = 'P'
        union all select 'e.csv', * replace (order_id + 1000000000 as order_id, null as customer_id) from o where status = 'F'
        union all select 'f.csv', * replace (-1 - order_id as order_id, price + 2 as price) from o where status = 'P')"""
REPORT_SQL = f"""{FILES_SQL},
    report as (
        select 'order' as "table", source_file,
            case when source_file in ('d.csv', 'e.csv') then 0 else count(*) end as rows,
            0::bigint as replaced, case when source_file in ('d.csv', 'e.csv') then 'error' else 'loaded' end as status,
            case source_file when 'd.csv' then 'UNIQUE constraint failed: order.order_id'
                when 'e.csv' then 'NOT NULL constraint failed: order.customer_id' else '' end as reason
        from files group by source_file)"""



def _report_sql() -> str:
    """Files without a mapping for a target are reported as skipped."""
    named = {"customer": "customer", "order": "orders", "product": "part"}
    rows = ["select 'run' as part, 'customer.csv orders.csv part.csv' as a, 'customer order product brand' as b, 'true' as c, '' as d"]
    for spec in MIGRATED:
        for source in ("customer", "orders", "part"):
            if named.get(spec.name) == source:
                rows.append(f"select 'rows_loaded', '{spec.name}', '{source}.csv', cast(count(*) as varchar), 'loaded' from {source}")
            else:
                rows.append(f"select 'rows_loaded', '{spec.name}', '{source}.csv', '0', 'skipped: {NO_MAPPING}'")
        rows += [
            f"select 'target_columns', '{spec.name}', '{c.name}', '{c.sql_type}', '{str(c.primary_key).lower()}'" for c in spec.columns
        ]
        bad = "count(c_nationkey)" if spec.name == "customer" else "0"
        status = "warning" if spec.name == "customer" else "ok"
        if spec.name in named:
            counted = f"cast(count(*) as varchar), cast({bad} as varchar), '{status}' from {named[spec.name]}"
        else:
            counted = "'0', '0', 'ok'"
        rows.append(f"select 'validation', '{spec.name}', {counted}")
    rows += [
        f"select 'mappings', '{m.target_table}', '{m.target_column}', '{m.source_file}.{m.source_column}', '{m.transformation or ''}'"
        for m in MAPPINGS
    ]
    return " union all ".join(rows)


ORACLES = {
    "migrate_report": _report_sql(),
    "extend_project": """
        select o_orderkey as order_id, o_custkey as customer_id, case when o_orderstatus = 'O' then o_totalprice + 1 else o_totalprice end as price,
            case when o_orderstatus = 'O' then o_orderpriority end as priority, c_mktsegment as customer_segment
        from orders left join customer on o_custkey = c_custkey""",
    "load_recreate": f"select {STORED_SQL} from orders",
    "load_multi_file": f"select * replace (case when status <> 'O' then price end as price) from (select {STORED_SQL} from orders)",
    "load_file_atomic": f"""{FILES_SQL}
        select order_id, customer_id, status, price, order_date from files where source_file not in ('d.csv', 'e.csv')""",
    "load_contested": f"""
        with p as (select page_id, url, page_id // {FILE_PAGES} as batch from pages),
        again as (select page_id, url || '#again' as url, batch + 1 as batch from p where page_id % {FILE_PAGES} = 0 and length(url) % 3 <> 0),
        rows as (select * from p union all select * from again),
        files as (select distinct batch, batch in (select batch from again) as shares from rows),
        chains as (select batch, sum(case when shares then 0 else 1 end) over (order by batch) as chain from files),
        placed as (select batch, row_number() over (partition by chain order by batch) as place from chains)
        select rows.* from rows join placed using (batch) where place % 2 = 1""",
    "load_report": f"{REPORT_SQL} select * from report",
    "load_report_parts": """
        select 'client' as "table", c_mktsegment as source_file, count(*) filter (c_mktsegment <> 'MACHINERY') as rows, 0::bigint as replaced,
            case when c_mktsegment = 'MACHINERY' then 'skipped' else 'loaded' end as status,
            case when c_mktsegment = 'MACHINERY' then 'All transformed rows were empty' else '' end as reason
        from customer group by c_mktsegment""",
    "load_total": f"{REPORT_SQL} select cast(sum(rows) as bigint) as total_rows from report",
    "quarantine_rows": f"""{FILES_SQL},
        judged as (
            select *, case when customer_id is null then 'not_null: customer_id' end as flaw from files),
        ranked as (
            select *, row_number() over (partition by order_id, flaw is null order by source_file) as place from judged)
        select source_file, order_id, customer_id, status, price, order_date,
            case when flaw is not null then flaw when place > 1 then 'duplicate_key' else 'good' end as reason
        from ranked""",
    "load_upsert": f"""
        with o as (select {STORED_SQL}, o_orderpriority = '1-URGENT' as urgent from orders)
        select * exclude (urgent) from o where not urgent
        union all select order_id, customer_id, null, price + 1, null from o where urgent
        union all select -1 - order_id, customer_id, null, price + 1, null from o where urgent""",
    "upsert_touched": f"""
        with o as (select {STORED_SQL} from orders), top as (select order_id from o order by price desc, order_id limit 1)
        select o.* replace (case when order_id = (select order_id from top) then price + 1 else price end as price), 1 as buckets_written from o""",
    "upsert_last_wins": """
        select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice, l_quantity from lineitem
        qualify row_number() over (partition by l_orderkey, l_linenumber
            order by l_shipdate desc, l_partkey desc, l_extendedprice desc, l_quantity desc) = 1""",
    "surrogate_key": """
        with c as (
            select case when c_mktsegment <> 'MACHINERY' then c_custkey end as customer_id, c_name as full_name,
                c_mktsegment as segment, c_acctbal as balance, c_nationkey as nation_id from customer)
        select * from c where customer_id is not null
        union all
        select (select max(customer_id) from c) + row_number() over (order by full_name), * exclude (customer_id)
        from c where customer_id is null""",
    "evolve_columns": """
        select c_custkey as customer_id, c_name as full_name, c_mktsegment as segment,
            case when c_mktsegment <> 'BUILDING' then c_acctbal end as balance
        from customer""",
    "raw_counts": " union all ".join(
        f"select 'raw_{t}' as \"table\", count(*) as rows from {t}" for t in ("customer", "orders", "part")
    ),
    "migrate_selected": """
        select 'product' as table_name, count(*) as row_count from part
        union all select 'customer', 0 union all select 'order', 0 union all select 'brand', 0""",
    "migrate_project": """
        select c_custkey as customer_id, cast(null as varchar) as full_name, upper(c_mktsegment) as segment,
            cast(null as double) as balance, cast(c_nationkey as bigint) as nation_id from customer""",
    "migrate_all": """
        select 'customer' as "table", count(*) as row_count, count(c_nationkey) as fk_violations,
            0::bigint as null_violations, 'warning' as status from customer
        union all
        select 'order', count(*), 0, 0, 'ok' from orders
        union all select 'product', count(*), 0, 0, 'ok' from part
        union all select 'brand', count(*), 0, 0, 'ok' from part""",
}
