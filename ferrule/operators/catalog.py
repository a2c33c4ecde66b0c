"""Catalog model (A6-A9, D5): metadata DataFrames and a per-table spec.

The catalog is metadata: one row per table / column / key column.  Lookups
are DataFrame joins; only the column list of the one table being validated
is brought to the driver to build the rule expression (its size is the
table's width, not its row count).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import family

CATALOG_TABLES_SCHEMA = "table_schema string, table_name string"
CATALOG_COLUMNS_SCHEMA = ("table_schema string, table_name string, column_name string, ordinal int, "
                          "is_nullable string, data_type string, char_max_len int, "
                          "numeric_precision int, numeric_scale int, column_default string, collation string")
CATALOG_CONSTRAINTS_SCHEMA = ("catalog string, schema string, table_name string, "
                              "constraint_name string, constraint_type string")
CATALOG_KEY_COLUMNS_SCHEMA = ("catalog string, schema string, table_name string, "
                              "constraint_name string, column_name string")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: str
    nullable: bool = True
    char_max_len: int | None = None
    precision: int | None = None
    scale: int | None = None
    ordinal: int = 0
    default: str | None = None       # SQL text of the value an insert gives when it leaves the column out
    collation: str | None = None     # how texts are compared as keys; None is byte by byte

    @property
    def family(self) -> str:
        return family(self.data_type)


@dataclass(frozen=True)
class TableSpec:
    table: str                      # "schema.table"
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = field(default_factory=tuple)

    def column(self, name: str) -> ColumnSpec | None:
        low = name.lower()
        for c in self.columns:
            if c.name.lower() == low:
                return c
        return None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def edit_stamp_column(self) -> str | None:
        """``edit_dt`` if the table has it, else ``edit_date``."""
        low = {c.name.lower(): c.name for c in self.columns}
        for name in ("edit_dt", "edit_date"):
            if name in low:
                return low[name]
        return None


def by_shuffle(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast.  Spark takes a catalog's size from the file it is unfolded from, so
    one of millions of columns looks small enough to broadcast, and breaks the driver."""
    return df.hint("merge")


@dataclass
class Catalog:
    """The four metadata DataFrames of a catalog."""

    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    key_columns: DataFrame

    def primary_keys(self) -> DataFrame:
        """Constraints joined to key columns on the 4-column key, PRIMARY KEY only."""
        c = self.constraints.where(F.col("constraint_type") == "PRIMARY KEY").alias("c")
        k = by_shuffle(self.key_columns).alias("k")
        return (c.join(k, on=[F.col("c.table_name") == F.col("k.table_name"),
                             F.col("c.catalog") == F.col("k.catalog"),
                             F.col("c.schema") == F.col("k.schema"),
                             F.col("c.constraint_name") == F.col("k.constraint_name")], how="inner")
                .select(F.col("k.schema").alias("table_schema"), F.col("k.table_name").alias("table_name"),
                        F.col("k.column_name").alias("column_name")))

    def user_tables(self) -> DataFrame:
        """Table names, skipping system tables whose name contains ``msys``."""
        return (self.tables.where(~F.lower(F.col("table_name")).contains("msys"))
                .select("table_schema", "table_name"))

    def spec(self, table: str) -> TableSpec | None:
        """Resolve one table's spec (metadata only) for building its rule chain."""
        return self.specs([table]).get(table)

    def specs(self, tables: list[str]) -> dict[str, TableSpec]:
        """The specs of those ``tables`` that have columns, by two look-ups for all of them (metadata only)."""
        named = [t for t in tables if len(t.split(".")) == 2]
        if not named:
            return {}
        mine = F.concat_ws(".", "table_schema", "table_name")
        columns: dict[str, list] = {}
        for r in self.columns.withColumn("_full", mine).where(F.col("_full").isin(named)).collect():
            columns.setdefault(r["_full"], []).append(r)
        keys: dict[str, list[str]] = {}
        for r in self.primary_keys().withColumn("_full", mine).where(F.col("_full").isin(named)).collect():
            keys.setdefault(r["_full"], []).append(r["column_name"])

        def own(r, name: str) -> str | None:      # facts that a catalog may not have
            return r[name] if name in r else None

        return {table: TableSpec(
            table=table,
            columns=tuple(ColumnSpec(r["column_name"], r["data_type"], r["is_nullable"] == "YES",
                                     r["char_max_len"], r["numeric_precision"], r["numeric_scale"],
                                     r["ordinal"], own(r, "column_default"), own(r, "collation"))
                          for r in sorted(rows, key=lambda r: r["ordinal"])),
            primary_key=tuple(keys.get(table, ()))) for table, rows in columns.items()}


def catalog_from_specs(spark: SparkSession, specs: list[TableSpec], db: str = "warehouse") -> Catalog:
    """Build catalog DataFrames from declared specs (metadata rows)."""
    tables, columns, constraints, keys = [], [], [], []
    for s in specs:
        schema, name = s.table.split(".")
        tables.append((schema, name))
        for i, c in enumerate(s.columns, start=1):
            columns.append((schema, name, c.name, c.ordinal or i, "YES" if c.nullable else "NO",
                            c.data_type, c.char_max_len, c.precision, c.scale, c.default, c.collation))
        if s.primary_key:
            cname = f"pk_{name}"
            constraints.append((db, schema, name, cname, "PRIMARY KEY"))
            keys.extend((db, schema, name, cname, k) for k in s.primary_key)
    return Catalog(
        tables=spark.createDataFrame(tables, CATALOG_TABLES_SCHEMA),
        columns=spark.createDataFrame(columns, CATALOG_COLUMNS_SCHEMA),
        constraints=spark.createDataFrame(constraints, CATALOG_CONSTRAINTS_SCHEMA),
        key_columns=spark.createDataFrame(keys, CATALOG_KEY_COLUMNS_SCHEMA),
    )


def declared_type(field: T.StructField) -> T.DataType:
    """A column's type as declared: a table keeps ``varchar(n)`` as metadata of a plain string column."""
    text = (field.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING")
    found = re.fullmatch(r"(char|varchar)\((\d+)\)", text or "")
    if not found:
        return field.dataType
    return (T.CharType if found[1] == "char" else T.VarcharType)(int(found[2]))


def spec_from_schema(table: str, schema: T.StructType, primary_key: tuple[str, ...] = ()) -> TableSpec:
    """A7 from a Spark schema: map Spark types to declared SQL Server types."""
    cols = []
    pk = {k.lower() for k in primary_key}
    for i, f in enumerate(schema.fields, start=1):
        dt = declared_type(f)
        if isinstance(dt, T.ByteType):
            c = ColumnSpec(f.name, "tinyint", precision=3, scale=0)
        elif isinstance(dt, T.BinaryType):
            c = ColumnSpec(f.name, "varbinary", char_max_len=-1)
        elif isinstance(dt, T.LongType):
            c = ColumnSpec(f.name, "bigint", precision=19, scale=0)
        elif isinstance(dt, T.IntegerType):
            c = ColumnSpec(f.name, "int", precision=10, scale=0)
        elif isinstance(dt, T.ShortType):
            c = ColumnSpec(f.name, "smallint", precision=5, scale=0)
        elif isinstance(dt, T.BooleanType):
            c = ColumnSpec(f.name, "bit", precision=1, scale=0)
        elif isinstance(dt, T.DoubleType):
            c = ColumnSpec(f.name, "float", precision=53)
        elif isinstance(dt, T.FloatType):
            c = ColumnSpec(f.name, "real", precision=24)
        elif isinstance(dt, T.DecimalType):
            c = ColumnSpec(f.name, "decimal", precision=dt.precision, scale=dt.scale)
        elif isinstance(dt, T.DateType):
            c = ColumnSpec(f.name, "date")
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            c = ColumnSpec(f.name, "datetime2")
        elif isinstance(dt, (T.VarcharType, T.CharType)):
            c = ColumnSpec(f.name, "varchar" if isinstance(dt, T.VarcharType) else "char",
                           char_max_len=dt.length)
        else:
            c = ColumnSpec(f.name, "nvarchar", char_max_len=-1)
        cols.append(ColumnSpec(c.name, c.data_type, f.nullable and f.name.lower() not in pk, c.char_max_len,
                               c.precision, c.scale, i))
    return TableSpec(table, tuple(cols), tuple(primary_key))
