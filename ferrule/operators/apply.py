"""Applying accepted rows to a target.

The target may be far larger than the batch.  Every join here is an equi
join on a key column, without a hint: AQE has measured sizes and broadcasts
the batch's side where that is cheaper.  A key may be one column of a wider
primary key, so it need not be unique in the target.  No step collects rows
to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions.types import spark_type
from .catalog import ColumnSpec, TableSpec
from .rules import prep_name, qcol, qsql


# --- C12/C13: typed projection of accepted text rows ------------------------------

def typed_value(spec: ColumnSpec, name: str, present: frozenset[str] = frozenset()) -> Column:
    """Target-typed value of a validated text cell; reuses the chain's parsed values when kept."""
    c = qcol(name)
    target = spark_type(spec.data_type, spec.precision, spec.scale)
    fam = spec.family
    ts_col, dec_col = prep_name("ts", name), prep_name("dec", name)
    if fam == "datetime" and spec.data_type.lower() != "time":
        parsed = F.col(ts_col) if ts_col in present else S.parse_datetime(c)
        ts = parsed.cast("timestamp_ntz")
        return ts.cast("date") if target == "date" else ts
    if fam == "integer" and prep_name("lng", name) in present:
        dec = F.coalesce(F.col(prep_name("lng", name)).cast("decimal(38,10)"), F.col(dec_col))
    else:
        dec = F.col(dec_col) if dec_col in present else S.as_decimal(c)
    if fam == "integer" and target != "boolean":
        return dec.try_cast(target)
    if target == "boolean":
        return dec.try_cast("int").try_cast("boolean")
    if fam == "numeric":
        return F.trim(c).try_cast(target)
    return c


def typed_value_sql(spec: ColumnSpec, name: str) -> str:
    q = qsql(name)
    target = spark_type(spec.data_type, spec.precision, spec.scale)
    duck = {"timestamp_ntz": "TIMESTAMP", "string": "VARCHAR", "float": "REAL"}.get(target, target.upper())
    fam = spec.family
    if fam == "datetime" and spec.data_type.lower() != "time":
        ts = S.parse_datetime_sql(q)
        return f"CAST({ts} AS DATE)" if target == "date" else ts
    if fam == "integer" and target != "boolean":
        return f"TRY_CAST({S.as_decimal_sql(q)} AS {duck})"
    if target == "boolean":
        return f"TRY_CAST(TRY_CAST({S.as_decimal_sql(q)} AS INTEGER) AS BOOLEAN)"
    if fam == "numeric":
        return f"TRY_CAST(trim({q}) AS {duck})"
    return q


def typed(batch: DataFrame, spec: TableSpec, header: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Cast the header columns to the target's types, named as in the target."""
    cols = [F.col(k) for k in keep]
    present = frozenset(batch.columns)
    for h in header:
        cs = spec.column(h)
        cols.append(typed_value(cs, h, present).alias(cs.name))
    return batch.select(*cols)


def typed_sql(spec: TableSpec, header: tuple[str, ...], keep: tuple[str, ...] = ()) -> str:
    parts = list(keep)
    for h in header:
        cs = spec.column(h)
        parts.append(f"{typed_value_sql(cs, h)} AS {qsql(cs.name)}")
    return ", ".join(parts)


# --- C13/C14: edit stamp ------------------------------------------------------------

def edit_stamp(batch: DataFrame, spec: TableSpec, auto_edit: bool, as_of: str) -> DataFrame:
    """C13 stamps the table's edit column with ``as_of`` (overriding any batch value);
    C14 drops both edit columns from the batch."""
    present = [c for c in batch.columns if c.lower() in ("edit_dt", "edit_date")]
    if not auto_edit:
        return batch.drop(*present)
    stamp = spec.edit_stamp_column()
    if stamp is None:
        return batch
    return batch.drop(*present).withColumn(stamp, F.lit(as_of).cast("timestamp_ntz"))


# --- duplicate keys inside one update ---------------------------------------------

def resolve_duplicates(batch: DataFrame, key: str, order: str = "row_no", collation: str | None = None) -> DataFrame:
    """One row per key: the highest ``order`` wins (later row in the tab).

    ``max_by`` is a partial aggregate, so a hot key is combined map-side and
    never gathers its rows in one task.  Keys that ``collation`` holds equal are one key, spelled as in the row that wins."""
    others = [c for c in batch.columns if c != key or collation]
    packed = F.struct(*[F.col(c) for c in others])
    one = batch.groupBy(compared(F.col(key), collation).alias(COMPARED if collation else key)).agg(F.max_by(packed, F.col(order)).alias("_w"))
    kept = [F.col("_w")[c].alias(c) for c in others]
    return one.select(*kept) if collation else one.select(key, *kept)


# --- keys as the source database compares them --------------------------------------------

COMPARED = "_compared"


def compared(key: Column, collation: str | None) -> Column:
    """A text key as joins and groupings compare it: under ``collation`` (a Spark collation's name), or byte by byte."""
    return F.collate(key, collation) if collation else key


def _key_join(rows: DataFrame, keys: DataFrame, key: str, collation: str | None, how: str) -> DataFrame:
    """``rows`` semi- or anti-joined to the values of ``key`` in ``keys``."""
    if not collation:
        return rows.join(keys.select(key), key, how).select(rows.columns)
    named = keys.select(compared(F.col(key), collation).alias(COMPARED))
    return rows.withColumn(COMPARED, compared(F.col(key), collation)).join(named, COMPARED, how).select(rows.columns)


# --- D1/D2: key existence -------------------------------------------------------------

REJECT_SALTS = 1 << 16


def mark_missing_keys(annotated: DataFrame, key_value: Column, target: DataFrame, key: str,
                      unique: bool = True) -> DataFrame:
    """D1+D2 in the same pass as validation: accepted rows whose key is absent get rule D2.

    ``key_value`` is the typed key of a row (evaluated on accepted rows only).  The validated
    batch is read once: rejected rows have no key to look for, and a salt in the join key spreads
    them over all tasks (accepted rows and the target have salt 0).  ``unique``: the key is the
    target's whole primary key; otherwise its values are made distinct first."""
    from .rules import RULE_TEXT

    ok = F.col("rule_id").isNull()
    salt = F.when(ok, 0).otherwise(F.pmod(F.xxhash64("row_no"), F.lit(REJECT_SALTS)) + 1)
    keyed = annotated.withColumn("_k", F.when(ok, key_value)).withColumn("_s", salt.cast("int"))
    tk = target.select(F.col(key).alias("_k"))
    tk = (tk if unique else tk.distinct()).withColumn("_s", F.lit(0)).withColumn("_hit", F.lit(True))
    flagged = keyed.join(tk, ["_k", "_s"], "left")
    d2 = ok & F.col("_hit").isNull()
    return (flagged.withColumn("rule_column", F.when(d2, F.lit(key)).otherwise(F.col("rule_column")))
            .withColumn("rule_message", F.when(d2, F.lit(RULE_TEXT["D2"])).otherwise(F.col("rule_message")))
            .withColumn("rule_id", F.when(d2, F.lit("D2")).otherwise(F.col("rule_id")))
            .drop("_k", "_s", "_hit"))


def missing_keys(batch: DataFrame, target: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    """D1+D2: accepted rows whose key is not in the target (rejected as D2); one pass over either side."""
    return _key_join(batch, target, key, collation, "left_anti")


def existing_keys(batch: DataFrame, target: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    return _key_join(batch, target, key, collation, "left_semi")


# --- D3: before image -------------------------------------------------------------------

def before_image(batch: DataFrame, target: DataFrame, key: str, columns: list[str],
                 carry: list[str] | None = None, collation: str | None = None) -> DataFrame:
    """Target's key + the changed columns, for keys the batch touches (old values).

    ``carry`` brings batch columns along (e.g. ``row_no``); the batch must
    then hold one row per key (see :func:`resolve_duplicates`)."""
    old = target.select(key, *[c for c in columns if c != key])
    if not collation:
        return old.join(batch.select(key, *(carry or [])).distinct(), key, "inner")
    keys = batch.select(compared(F.col(key), collation).alias(COMPARED), *(carry or [])).distinct()
    return old.withColumn(COMPARED, compared(F.col(key), collation)).join(keys, COMPARED).drop(COMPARED)


# --- D4/E2: update ------------------------------------------------------------------------

def apply_update(target: DataFrame, batch: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    """New target: matched rows take every batch column (NULL overwrites), others keep theirs.

    ``batch`` is typed, resolved to one row per key and holds only keys that
    exist.  Target LEFT JOIN batch is one map-only pass over the target wherever AQE
    finds the batch small enough to broadcast.  A key is found under ``collation`` and stays as the target has it."""
    set_cols = [c for c in batch.columns if c != key]
    named = compared(F.col(key), collation).alias(COMPARED)
    b = batch.select(named, *[F.col(c).alias(f"_new_{c}") for c in set_cols]).withColumn("_hit", F.lit(True))
    joined = target.select("*", named).join(b, COMPARED, "left")
    out = []
    for c in target.columns:
        if c in set_cols:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
                       .cast(target.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


# --- E1/B2: insert -------------------------------------------------------------------------

def unlisted(name: str, spec: TableSpec | None = None) -> Column:
    """What an insert that leaves out column ``name`` gives it: its declared default, or NULL."""
    column = spec.column(name) if spec else None
    return F.lit(None) if column is None or column.default is None else F.expr(column.default)


def insert_columns(batch: DataFrame, schema: StructType, spec: TableSpec | None = None) -> DataFrame:
    """Insert by column list: unlisted target columns take their default, NULL or a generated key; a listed NULL stays NULL."""
    return batch.select(*[(F.col(f.name) if f.name in batch.columns else unlisted(f.name, spec)).cast(f.dataType).alias(f.name)
                          for f in schema])


def apply_insert(target: DataFrame, batch: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    return target.unionByName(insert_columns(batch, target.schema, spec))


def sequence_keys(batch: DataFrame, key: str, base: Column | int, order: list[str]) -> DataFrame:
    """Contiguous generated keys ``base + 1, base + 2, ...`` in ``order``.

    No global window: rows are range-partitioned on ``order`` and sorted
    within partitions; each row's number is its index inside its partition
    plus the rows of all earlier partitions (a running sum over the per-
    partition counts - one row per partition, so its size is bounded by the
    partition count and it is broadcast)."""
    ranged = batch.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranged = ranged.checkpoint()   # fixes partition contents for both passes; lineage cut
    pid, mono = F.spark_partition_id(), F.monotonically_increasing_id()
    local = ranged.withColumn("_pid", pid).withColumn("_idx", mono - (F.col("_pid").cast("bigint") * (1 << 33)))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    base_col = base if isinstance(base, Column) else F.lit(base)
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(key, (base_col + F.col("_off") + F.col("_idx") + 1).cast("bigint"))
            .drop("_pid", "_idx", "_off"))
