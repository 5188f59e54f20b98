"""Target tables as versioned Parquet folders."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from martloom.functions import col
from martloom.operators.checks import has_keys
from martloom.operators.keys import replaced
from martloom.session import drop_folder, list_folder, path_exists, read_text, write_text
from martloom.spec import ColumnSpec, TableSpec

# A plain folder, one bucketed as a whole (written by earlier releases), or one of bucket folders.
VERSION = re.compile(r"^v([0-9]{6})(?:_([bp])([0-9]+))?$")

# The bucket a row belongs to, as a folder of its version; rows without a key have a folder of their own.
BUCKET, KEYLESS = "__bucket", -1


@dataclass(frozen=True)
class Parts:
    """What a version is made of: for each bucket the version folder that holds it, and those that hold rows without a key."""

    count: int
    key: list[str]
    schema: StructType
    buckets: dict[int, str]
    keyless: list[str]

    def to_json(self) -> str:
        return json.dumps({"count": self.count, "key": self.key, "schema": self.schema.json(), "buckets": self.buckets, "keyless": self.keyless})

    @classmethod
    def from_json(cls, text: str) -> Parts:
        said = json.loads(text)
        buckets = {int(b): folder for b, folder in said["buckets"].items()}
        return cls(said["count"], said["key"], StructType.fromJson(json.loads(said["schema"])), buckets, said["keyless"])

    def folders(self) -> list[tuple[str, int]]:
        """(version, bucket) of every folder that holds rows."""
        return [(folder, b) for b, folder in sorted(self.buckets.items())] + [(folder, KEYLESS) for folder in self.keyless]


class TableStore:
    """Tables below one root.

    A write goes to a new version folder, which counts once Spark has committed it (its
    ``_SUCCESS`` marker), so readers never see half a table and a lost job leaves the old
    version in place.  Beside each version is its spec, so what a table means can be read back
    with it.  With ``buckets`` tables with a primary key are bucketed by it, and a version is a list of
    bucket folders: an upsert reads and writes the buckets that its batch touches, refers to the others where
    they are, and shuffles the batch only, not the stored rows.  Such a version counts once its list is written.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._catalogued: list[str] = []

    def tables(self) -> list[str]:
        return [name for name, folder in list_folder(self.spark, self.root) if folder and self._current(name)]

    def exists(self, table: str) -> bool:
        return self._current(table) is not None

    def read(self, table: str) -> DataFrame:
        path = self._current(table)
        if path is None:
            raise ValueError(f"no such table: {table}")
        return self._read(path, table)

    def spec(self, table: str) -> TableSpec | None:
        """The spec that the current version was written with; None for tables that have none."""
        path = self._current(table)
        said = read_text(self.spark, _spec_path(path)) if path else None
        return TableSpec.from_json(said) if said else None

    def specs(self) -> list[TableSpec]:
        """The specs of all tables that have one, by name."""
        return [spec for name in self.tables() if (spec := self.spec(name))]

    def write(self, spec: TableSpec, df: DataFrame, seen: Observation | None = None, **metrics: Column) -> DataFrame:
        """Replace the table; returns it as stored. Metrics of its rows are observed as they are written."""
        df = df.select(*map(col, spec.column_names))
        bucketed = bool(spec.primary_key and self.buckets)
        rows = self._by_bucket(df, spec.primary_key, self.buckets) if bucketed else df
        if seen is not None:
            rows = rows.observe(seen, *(m.alias(name) for name, m in metrics.items()))
        return self._publish_parts(spec, rows, None) if bucketed else self._publish(spec, rows)

    def upsert(self, spec: TableSpec, batch: DataFrame) -> DataFrame:
        """Replace whole rows by primary key; without a key, append.

        ``batch`` has at most one row per key.  The table is created when missing, and columns
        new in the spec are added to it.
        """
        batch = batch.select(*map(col, spec.column_names))
        if not self.exists(spec.name):
            return self.write(spec, batch)
        key, parts = spec.primary_key, self.parts(spec.name)
        if key and parts and self.buckets == parts.count and parts.key == key and _fits(parts.schema, batch.schema):
            touched = batch.agg(F.collect_set(bucket_of(key, parts.count))).first()[0]  # at most one value a bucket
            stored = self._bucketed(spec, [b for b in touched if b in parts.buckets])
            rows = self._by_bucket(batch, key, parts.count)
            merged = replaced(stored, rows.where(has_keys(key)), key).unionByName(rows.where(~has_keys(key)), allowMissingColumns=True)
            whole, names = self._whole(spec, [f.name for f in parts.schema.fields])
            return self._publish_parts(whole, merged.select(*map(col, names)), parts)
        existing = self.read(spec.name)
        if key:
            keyless = existing.where(~has_keys(key))
            merged = replaced(existing.where(has_keys(key)), batch, key).unionByName(keyless, allowMissingColumns=True)
        else:
            merged = existing.unionByName(batch, allowMissingColumns=True)
        whole, names = self._whole(spec, merged.columns)
        return self.write(whole, merged.select(*map(col, names)))

    def _whole(self, spec: TableSpec, columns: Sequence[str]) -> tuple[TableSpec, list[str]]:
        """The spec with the columns that only the stored table has: they stay, and have no value in new rows."""
        extra = [c for c in columns if c not in spec.column_names]
        stored = self.spec(spec.name)
        types = {c.name: c.sql_type for c in stored.columns} if stored else {}
        kept = [ColumnSpec(c, types[c]) for c in extra if c in types]
        whole = TableSpec(spec.name, (*spec.columns, *kept), spec.foreign_keys)
        return whole, [*spec.column_names, *extra]

    def publish(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table that has no spec; returns it as stored."""
        return self._publish(TableSpec(name, (), ()), df)

    def vacuum(self, table: str, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` committed versions, and what lost jobs left before them; returns their names.

        Bucket folders that a kept version refers to stay, in the folder of the version that wrote them.
        """
        last = [n for _, n in self._versions(table) if self._committed(table, n)][-max(1, keep) :]
        kept = {folder for n in last if (parts := self._read_parts(table, n)) for folder in parts.folders()}
        gone = []
        for _, name in self._versions(table):
            if not last or name >= last[0]:
                continue
            path = f"{self.root}/{table}/{name}"
            owned = [(name, int(f.removeprefix(f"{BUCKET}="))) for f, folder in list_folder(self.spark, path) if folder and f.startswith(f"{BUCKET}=")]
            for folder in owned:
                if folder not in kept:
                    drop_folder(self.spark, self._bucket_path(table, *folder))
            if self._committed(table, name) or not kept.intersection(owned):
                gone.append(name)
            drop_folder(self.spark, _parts_path(path))
            drop_folder(self.spark, _spec_path(path))
            if not kept.intersection(owned):
                drop_folder(self.spark, path)
        return gone

    def parts(self, table: str) -> Parts | None:
        """What the current version is made of; None for one that is a single folder."""
        path = self._current(table)
        return self._read_parts(table, path.rsplit("/", 1)[-1]) if path else None

    def _versions(self, table: str) -> list[tuple[int, str]]:
        names = [name for name, folder in list_folder(self.spark, f"{self.root}/{table}") if folder]
        return sorted((int(m.group(1)), name) for name in names if (m := VERSION.match(name)))

    def _current(self, table: str) -> str | None:
        for _, name in reversed(self._versions(table)):
            if self._committed(table, name):
                return f"{self.root}/{table}/{name}"
        return None

    def _committed(self, table: str, version: str) -> bool:
        path = f"{self.root}/{table}/{version}"
        listed = VERSION.match(version).group(2) != "p" or path_exists(self.spark, _parts_path(path))
        return listed and path_exists(self.spark, f"{path}/_SUCCESS")

    def _read_parts(self, table: str, version: str) -> Parts | None:
        said = read_text(self.spark, _parts_path(f"{self.root}/{table}/{version}"))
        return Parts.from_json(said) if said else None

    def _bucket_path(self, table: str, version: str, bucket: int) -> str:
        return f"{self.root}/{table}/{version}/{BUCKET}={bucket}"

    def _read(self, path: str, table: str) -> DataFrame:
        version = path.rsplit("/", 1)[-1]
        parts = self._read_parts(table, version)
        if parts is None:
            return self.spark.read.parquet(path)
        folders = parts.folders()
        if not folders:
            return self.spark.createDataFrame([], parts.schema)
        reader = self.spark.read.schema(parts.schema)
        if {folder for folder, _ in folders} == {version}:
            return reader.parquet(path).select(*map(col, parts.schema.names))
        return reader.parquet(*(self._bucket_path(table, *f) for f in folders))

    def _by_bucket(self, df: DataFrame, key: Sequence[str], count: int) -> DataFrame:
        """Rows with a key dealt out as their buckets are; those without one, which may be many, stay where they are."""
        keyed = df.where(has_keys(key)).repartition(count, *map(col, key))
        return keyed.unionByName(df.where(~has_keys(key)))

    def _bucketed(self, spec: TableSpec, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The rows with a key of the current version (of some buckets, if given), read with their buckets; None when it has none."""
        parts = self.parts(spec.name)
        if parts is None:
            return None
        chosen = sorted(parts.buckets if buckets is None else buckets)
        name = f"martloom_{uuid.uuid4().hex}"
        keys = ", ".join(map(_quoted, parts.key))
        fields = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in parts.schema.fields)
        self._catalogued.append(name)
        self.spark.sql(
            f"CREATE TABLE {name} ({fields}, {BUCKET} int) USING parquet PARTITIONED BY ({BUCKET}) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {parts.count} BUCKETS LOCATION {_literal(f'{self.root}/{spec.name}/_{name}')}"
        )
        if chosen:
            places = " ".join(
                f"PARTITION ({BUCKET}={b}) LOCATION {_literal(self._bucket_path(spec.name, parts.buckets[b], b))}" for b in chosen
            )
            self.spark.sql(f"ALTER TABLE {name} ADD {places}")
        return self.spark.table(name).select(*map(col, parts.schema.names))

    def _publish(self, spec: TableSpec, df: DataFrame) -> DataFrame:
        path = self._next(spec, "")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _publish_parts(self, spec: TableSpec, df: DataFrame, before: Parts | None) -> DataFrame:
        """Write the buckets of these rows, and the list of them and of those that are as they were."""
        key, count = spec.primary_key, before.count if before else self.buckets
        path = self._next(spec, f"_p{count}")
        version, name = path.rsplit("/", 1)[-1], f"martloom_{uuid.uuid4().hex}"
        self._catalogued.append(name)
        writer = df.withColumn(BUCKET, bucket_of(key, count)).write.format("parquet").partitionBy(BUCKET).bucketBy(count, *key).sortBy(*key)
        try:
            writer.option("path", path).mode("error").saveAsTable(name)
        finally:  # catalogue entries only carry the bucketing; dropping them leaves the files
            while self._catalogued:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._catalogued.pop()}")
        written = {int(f.removeprefix(f"{BUCKET}=")) for f, folder in list_folder(self.spark, path) if folder and f.startswith(f"{BUCKET}=")}
        buckets = (before.buckets if before else {}) | {b: version for b in sorted(written - {KEYLESS})}
        keyless = (before.keyless if before else []) + [version] * (KEYLESS in written)
        write_text(self.spark, _parts_path(path), Parts(count, key, df.schema, buckets, keyless).to_json())
        return self._read(path, spec.name)

    def _next(self, spec: TableSpec, kind: str) -> str:
        """The folder of a new version, with its spec beside it, which counts once the version does."""
        versions = self._versions(spec.name)
        path = f"{self.root}/{spec.name}/v{versions[-1][0] + 1 if versions else 1:06d}{kind}"
        if spec.columns:
            write_text(self.spark, _spec_path(path), spec.to_json())
        return path


def bucket_of(key: Sequence[str], count: int) -> Column:
    """The bucket that Spark's own bucketing gives a key."""
    return F.when(has_keys(key), F.pmod(F.hash(*map(col, key)), F.lit(count))).otherwise(KEYLESS).cast("int").alias(BUCKET)


def _fits(stored: StructType, batch: StructType) -> bool:
    """Columns that both have are of one type, so rows of the two can stay in files of their own."""
    types = {f.name: f.dataType for f in stored.fields}
    return all(types.get(f.name, f.dataType) == f.dataType for f in batch.fields)


def _spec_path(version: str) -> str:
    return f"{version}.spec.json"


def _parts_path(version: str) -> str:
    return f"{version}.parts.json"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
