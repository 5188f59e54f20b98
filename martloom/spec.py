"""Target model: tables, columns, keys and the relationships between tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

INTEGER, REAL, TEXT = "integer", "real", "text"

SPARK_TYPE = {INTEGER: T.LongType(), REAL: T.DoubleType(), TEXT: T.StringType()}

# Parts of a declared type that make a column a real number.
REAL_MARKS = ("REAL", "FLOA", "DOUB", "DEC", "NUM")


def type_class(sql_type: str | None) -> str:
    """Class of a declared type; ``INT`` is looked for first, so POINT counts as integer."""
    declared = (sql_type or "").upper()
    if "INT" in declared:
        return INTEGER
    return REAL if any(mark in declared for mark in REAL_MARKS) else TEXT


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    sql_type: str = "TEXT"
    nullable: bool = True
    primary_key: bool = False

    @property
    def type_class(self) -> str:
        return type_class(self.sql_type)

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPE[self.type_class]


@dataclass(frozen=True)
class ForeignKey:
    """One constraint; several columns make one composite constraint."""

    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


@dataclass(frozen=True)
class Relationship:
    child_table: str
    child_columns: tuple[str, ...]
    parent_table: str
    parent_columns: tuple[str, ...]
    source: str

    @property
    def child_column(self) -> str:
        return ", ".join(self.child_columns)

    @property
    def parent_column(self) -> str:
        return ", ".join(self.parent_columns)


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    @property
    def column_names(self) -> list[str]:
        return [column.name for column in self.columns]

    @property
    def primary_key(self) -> list[str]:
        return [column.name for column in self.columns if column.primary_key]

    @property
    def required(self) -> list[str]:
        """NOT NULL columns outside the primary key."""
        return [c.name for c in self.columns if not c.nullable and not c.primary_key]

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name.lower() == name.lower())

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, c.spark_type, c.nullable, {"pk": c.primary_key}) for c in self.columns]
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        said = json.loads(text)
        links = [ForeignKey(tuple(k["columns"]), k["ref_table"], tuple(k["ref_columns"])) for k in said["foreign_keys"]]
        return cls(said["name"], tuple(ColumnSpec(**c) for c in said["columns"]), tuple(links))

    @property
    def generated_key(self) -> str | None:
        """The single integer primary key, whose missing values a load numbers itself."""
        keys = [c for c in self.columns if c.primary_key]
        if len(keys) == 1 and keys[0].type_class == INTEGER:
            return keys[0].name
        return None


def table(
    name: str,
    columns: str | T.StructType | Sequence[tuple[str, str]],
    primary_key: str | Iterable[str] = (),
    not_null: Iterable[str] = (),
    foreign_keys: dict[str | tuple[str, ...], tuple[str, str | tuple[str, ...]]] | None = None,
) -> TableSpec:
    """Describe a target table.

    ``columns`` is a ``name type, ...`` string, a StructType or a list of (name, type) pairs;
    ``foreign_keys`` maps child column(s) to (parent table, parent column(s)).
    """
    if isinstance(columns, str):
        pairs = [tuple(part.split(None, 1)) for part in columns.split(",")]
        pairs = [(p[0], p[1].strip() if len(p) > 1 else "TEXT") for p in pairs]
    elif isinstance(columns, T.StructType):
        pairs = [(f.name, declared_type(f.dataType)) for f in columns.fields]
    else:
        pairs = list(columns)
    keys = {primary_key} if isinstance(primary_key, str) else set(primary_key)
    required = set(not_null)
    specs = tuple(
        ColumnSpec(col, sql_type, nullable=col not in required, primary_key=col in keys) for col, sql_type in pairs
    )
    constraints = tuple(
        ForeignKey(_names(child), parent, _names(ref)) for child, (parent, ref) in (foreign_keys or {}).items()
    )
    return TableSpec(name, specs, constraints)


def declared_type(data_type: T.DataType) -> str:
    """Declared type of a Spark column: whole numbers and flags INTEGER, other numbers REAL."""
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "REAL"
    return "TEXT"


def _names(value: str | tuple[str, ...]) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)
