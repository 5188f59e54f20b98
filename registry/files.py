"""File sources: CSV, the JSON forms, flattening, raw landing, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from martloom.functions import col
from martloom.functions.display import json_text
from martloom.functions.names import identifier_column, table_name_column
from martloom.session import scratch_path
from martloom.sources import list_sources, scan
from martloom.sources.json import flatten
from martloom.sources.raw import land_raw
from registry.model import given, write_source

# Rows per JSON document, so that every document is a file of bounded size.
DOCUMENT_ROWS = 1000
LOADED_AT = "2024-01-01T00:00:00+00:00"


def write_documents(df: DataFrame, key: str, name: str, wrap: bool) -> str:
    """Write rows as JSON documents, a bounded number of rows and one file each."""
    record = F.to_json(F.struct(*map(col, df.columns)), {"ignoreNullFields": "false"})
    documents = df.groupBy(F.floor(col(key) / DOCUMENT_ROWS).alias("chunk")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value")
    )
    if wrap:
        start, end = F.lit('{"total": 1, "rows": '), F.lit(', "also": [{"c_custkey": -1}]}')
        documents = documents.withColumn("value", F.concat(start, "value", end))
    path = f"{scratch_path(df.sparkSession, 'source')}/{name}.json"
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, write_source(given(spark, sf_dir, "customer"), "customer", "csv"))


def scan_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, write_documents(given(spark, sf_dir, "customer"), "c_custkey", "customer", wrap=False))


def scan_json_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, write_documents(given(spark, sf_dir, "customer"), "c_custkey", "customer", wrap=True))


def scan_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, write_source(given(spark, sf_dir, "part"), "part", "json"))


def scan_json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines in several parts, one of which has a single line."""
    customers = given(spark, sf_dir, "customer")
    path = f"{scratch_path(spark, 'source')}/customer.json"
    customers.where("c_custkey = 1").coalesce(1).write.json(path)
    customers.where("c_custkey <> 1").repartition(3).write.mode("append").json(path)
    return scan(spark, path)


def scan_csv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files with the same columns in two orders."""
    customers = given(spark, sf_dir, "customer")
    path = f"{scratch_path(spark, 'source')}/customer.csv"
    customers.where("c_custkey % 2 = 0").write.option("header", True).csv(path)
    other = customers.where("c_custkey % 2 = 1").select(*reversed(customers.columns))
    other.write.mode("append").option("header", True).csv(path)
    return scan(spark, path)


def scan_csv_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files one folder down with the same columns in two orders, a stray quote and a value over two lines in each row."""
    note, tail = F.concat("c_name", F.lit(' 5" pipe')), F.concat(F.lit('"two\nlines of ""'), "c_mktsegment", F.lit('"""'))
    chunk = F.floor(F.col("c_custkey") / DOCUMENT_ROWS)
    lines = given(spark, sf_dir, "customer").select((chunk % 2).alias("order"), chunk.alias("chunk"), "c_custkey", note.alias("note"), tail.alias("tail"))
    cells = F.when(F.col("order") == 0, F.concat_ws(",", "c_custkey", "note", "tail")).otherwise(F.concat_ws(",", "note", "tail", "c_custkey"))
    header = F.when(F.col("order") == 0, "c_custkey,note,tail\n").otherwise("note,tail,c_custkey\n")
    files = lines.groupBy("order", "chunk").agg(F.concat(header, F.array_join(F.collect_list(cells), "\n")).alias("value"))
    path = f"{scratch_path(spark, 'source')}/customer.csv"
    files.select("order", "value").write.partitionBy("order").option("maxRecordsPerFile", 1).text(path)
    return scan(spark, path)


def scan_json_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines whose larger file, by a later path, has its keys in another order; the columns' order is part of the result."""
    customers = given(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment")
    path = f"{scratch_path(spark, 'source')}/customer.json"
    customers.where("c_custkey % 10 = 1").coalesce(1).write.json(f"{path}/1")
    customers.where("c_custkey % 10 <> 1").select(*reversed(customers.columns)).coalesce(1).write.json(f"{path}/2")
    df = scan(spark, path)
    return df.withColumn("order", F.lit(", ".join(df.columns)))


def scan_json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with nested keys that are not in alphabetical order; the columns' order is part of the result."""
    place = F.struct(F.col("c_nationkey").alias("zip"), F.col("c_mktsegment").alias("city"), F.struct("c_name").alias("area"))
    nested = given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), place.alias("addr"), F.col("c_acctbal").alias("a"))
    df = scan(spark, write_documents(nested, "key", "customer", wrap=False))
    return df.withColumn("order", F.lit(", ".join(df.columns)))


def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = given(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("props"), F.struct("user_id", F.struct("value").alias("v")).alias("who")
    )
    return flatten(nested)


def encode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000))
    pair = F.struct(F.size("embedding").alias("size"), "label", F.array("label", F.lit(None)).alias("also"), whole.alias("values"))
    nested = given(spark, sf_dir, "embeddings").select("vec_id", pair.alias("pair"))
    return nested.select("vec_id", json_text(F.col("pair"), nested.schema["pair"].dataType).alias("pair"))


def with_numbering(landed: DataFrame) -> DataFrame:
    """The landed rows; for their provenance, how their file is named and whether its rows are numbered 1 to n.

    Names of part files and the order of rows in them are up to the writer.
    """
    whole = (F.col("first_row") == 1) & (F.col("last_row") == F.col("rows")) & (F.col("numbers") == F.col("rows"))
    named = F.regexp_replace("_source_file", "^part-[0-9]+-.*[.]", "part.").alias("source_file")
    files = number_facts(landed).select("_source_file", named, whole.alias("numbered"))
    values = [c for c in landed.columns if c not in ("_source_file", "_raw_row_number")]
    # a row per file, as many as Spark's own listing holds; left to its estimate, all landed rows would be shuffled
    return landed.join(F.broadcast(files), "_source_file").select("source_file", "numbered", *map(col, values))


def raw_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_source(given(spark, sf_dir, "lineitem"), "source2_lineitem", "csv")
    return with_numbering(land_raw(spark, path, scratch_path(spark, "raw"), LOADED_AT).read())


def raw_land_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON Lines with an object and a list, landed as JSON text."""
    events = given(spark, sf_dir, "events").select(
        "event_id",
        F.from_json("props", "k bigint").alias("Props-1"),
        F.array("user_id", "event_id").alias("props 1"),
        F.col("event_type").alias("Event Type"),
    )
    path = write_source(events, "src_events", "json")
    return with_numbering(land_raw(spark, path, scratch_path(spark, "raw"), LOADED_AT).read())


def raw_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of part files that together are sorted by key: file after file they count the keys."""
    path = write_source(given(spark, sf_dir, "orders").orderBy("o_orderkey"), "orders", "csv")
    landed = land_raw(spark, path, scratch_path(spark, "raw"), LOADED_AT).read()
    sizes = landed.groupBy("_source_file").agg(F.max("_raw_row_number").alias("rows"))
    earlier = W.orderBy("_source_file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    starts = sizes.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return landed.join(F.broadcast(starts), "_source_file").select(
        "o_orderkey", (F.col("before") + F.col("_raw_row_number")).alias("row_number")
    )


def raw_land_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files of equal names in folders of their own: each is numbered by itself.

    Every task writes a file of its name to each folder, so a folder has as many files as tasks had its rows. The result adds
    up what they say of themselves.
    """
    path = f"{scratch_path(spark, 'source')}/orders.csv"
    given(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").option("header", True).csv(path)
    landed = land_raw(spark, path, scratch_path(spark, "raw"), LOADED_AT).read()
    return number_facts(landed).groupBy(F.regexp_extract("_source_file", "^o_orderstatus=(.)/", 1).alias("status")).agg(
        F.sum("rows").alias("rows"),
        F.min("first_row").alias("first_row"),
        F.sum("last_row").alias("last_row"),
        F.sum("numbers").alias("numbers"),
    )


def number_facts(landed: DataFrame) -> DataFrame:
    """Rows, first, last and different numbers of each file; 64 numbers are marked in one word, so no set of all numbers is held."""
    number = F.col("_raw_row_number")
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(64)).cast("int"))
    words = landed.groupBy("_source_file", F.floor(number / 64).alias("word")).agg(
        F.count("*").alias("rows"), F.min(number).alias("first_row"), F.max(number).alias("last_row"), F.bit_or(mark).alias("marks")
    )
    return words.groupBy("_source_file").agg(
        F.sum("rows").alias("rows"),
        F.min("first_row").alias("first_row"),
        F.max("last_row").alias("last_row"),
        F.sum(F.bit_count("marks")).alias("numbers"),
    )


def normalize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = given(spark, sf_dir, "pages").select(F.lit("url").alias("kind"), F.col("url").alias("name"))
    parts = given(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"))
    sizes = given(spark, sf_dir, "part").select(F.lit("size").alias("kind"), F.concat_ws(" - ", "p_size", "p_type").alias("name"))
    return urls.unionAll(parts).unionAll(sizes).withColumn("identifier", identifier_column(F.col("name")))


def table_name_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written under prefixed file names, found again and named."""
    root = scratch_path(spark, "source")
    names = {"region": "source1_Region.csv", "nation": "SRC_nation.json", "customer": "source2-raw_Customer-List.csv"}
    for name, file in names.items():
        writer = given(spark, sf_dir, name).write
        writer.option("header", True).csv(f"{root}/{file}") if file.endswith("csv") else writer.json(f"{root}/{file}")
    result = None
    for path in list_sources(spark, root):
        file = path.rsplit("/", 1)[-1]
        counted = scan(spark, path).agg(F.count("*").alias("rows")).withColumn("file", F.lit(file))
        result = counted if result is None else result.unionByName(counted)
    return result.withColumn("table_name", table_name_column(F.col("file")))


QUERIES = {
    "scan_csv": scan_csv,
    "scan_json_array": scan_json_array,
    "scan_json_wrapper": scan_json_wrapper,
    "scan_json_lines": scan_json_lines,
    "scan_json_parts": scan_json_parts,
    "scan_csv_parts": scan_csv_parts,
    "scan_csv_nested": scan_csv_nested,
    "scan_json_order": scan_json_order,
    "scan_json_nested": scan_json_nested,
    "flatten_json": flatten_json,
    "encode_nested": encode_nested,
    "raw_land": raw_land,
    "raw_land_json": raw_land_json,
    "raw_row_number": raw_row_number,
    "raw_land_nested": raw_land_nested,
    "normalize_identifier": normalize_identifier,
    "table_name_from_file": table_name_from_file,
}

CUSTOMER_SQL = (
    "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer"
)
IDENTIFIER_SQL = "trim(regexp_replace(lower(trim(name)), '[^a-zA-Z0-9_]+', '_', 'g'), '_')"

ORACLES = {
    "scan_csv": CUSTOMER_SQL,
    "scan_json_array": CUSTOMER_SQL,
    "scan_json_wrapper": CUSTOMER_SQL,
    "scan_json_lines": (
        "select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, p_retailprice from part"
    ),
    "scan_json_parts": CUSTOMER_SQL,
    "scan_csv_parts": CUSTOMER_SQL,
    "scan_json_nested": """
        select c_custkey as "key", cast(c_nationkey as bigint) as "addr.zip", c_mktsegment as "addr.city", c_name as "addr.area.c_name",
            c_acctbal as a, 'key, a, addr.zip, addr.city, addr.area.c_name' as "order" from customer""",
    "scan_csv_nested": """
        select c_custkey, c_name || ' 5" pipe' as note, 'two' || chr(10) || 'lines of "' || c_mktsegment || '"' as tail from customer""",
    "scan_json_order": "select c_name, c_custkey, c_mktsegment, 'c_name, c_custkey, c_mktsegment' as \"order\" from customer",
    "raw_land_nested": """
        select o_orderstatus as status, count(*) as rows, 1::bigint as first_row, count(*) as last_row, count(*) as numbers
        from orders group by o_orderstatus""",
    "flatten_json": """
        select event_id, cast(json_extract(props, '$.k') as bigint) as "props.k", user_id as "who.user_id",
            value as "who.v.value" from events""",
    "encode_nested": """
        select vec_id, '{"also": [' || label || ', null], "label": ' || label || ', "size": ' || len(embedding) || ', "values": ['
            || array_to_string(list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1000) as bigint)), ', ') || ']}' as pair
        from embeddings""",
    "raw_land": f"""
        select 'part.csv' as source_file, true as numbered, '{LOADED_AT}' as _loaded_at, l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber,
            l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
            strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate
        from lineitem""",
    "raw_land_json": f"""
        select 'part.json' as source_file, true as numbered, '{LOADED_AT}' as _loaded_at, event_id, props as props_1, '[' || user_id || ', ' || event_id || ']' as props_1_2,
            event_type from events""",
    "raw_row_number": "select o_orderkey, row_number() over (order by o_orderkey) as row_number from orders",
    "normalize_identifier": f"""
        with n as (
            select 'url' as kind, url as name from pages
            union all select 'part', p_name from part
            union all select 'size', p_size || ' - ' || p_type from part),
        i as (select *, {IDENTIFIER_SQL} as base from n),
        f as (select kind, name, case when base = '' then 'field' else base end as base from i)
        select kind, name, case when regexp_matches(base, '^[0-9]') then '_' || base else base end as identifier from f""",
    "table_name_from_file": """
        select 'source1_Region.csv' as file, 'region' as table_name, count(*) as rows from region
        union all select 'SRC_nation.json', 'nation', count(*) from nation
        union all select 'source2-raw_Customer-List.csv', 'customer_list', count(*) from customer""",
}
