"""One change run: parsed inbox cells -> validated, applied, preserved, reported.

A tab is identified by its file and its name, everywhere.  Tabs take effect in file order, then
sheet order; the order matters only within one target table, so a run handles each table once,
however its tabs alternate: the rows of all tables are validated in one plan, changes are chained per target
row in tab order, and one commit replaces the touched partitions and appends the new rows.

Only metadata reaches the driver: the distinct (table, mode, header) shapes, their tables' columns and the touched
partitions.  Quarantine, locker, errors and events are written per run and table with dynamic
partition overwrite, and before the table; the commit carries the run's token.  A retry
finds what is applied and leaves it, and writes the rest again to the same folders.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .. import fs
from ..functions import scalars as S
from ..functions.types import DEFAULT_AUTO_EDIT
from ..operators import apply as A
from ..operators import locker as L
from ..operators import quarantine as Q
from ..operators import rules as R
from ..operators.catalog import Catalog, TableSpec
from ..operators.gates import tab_gates
from ..operators.rule_table import judge, tab_facts
from ..operators.skipping import touched
from ..operators.tables import PART, TableStore, part_key
from ..session import scratch_dir
from ..sources import envelope as EV

GATED = "(gates)"        # quarantine partition of the tabs that never reach a table
KEYS = "(keys)"          # of the rows whose key a table does not have, after the table's name
QUARANTINE_SCHEMA = ("file string, authors string, tab string, target_table string, row_no bigint, row map<string,string>, "
                     "rule_column string, rule_id string, rule_message string, run_id string, part string")
EVENTS_SCHEMA = "event_time timestamp_ntz, level string, message string, run_id string"
TAB = ["path", "tab", "file_seq", "tab_seq", "authors"]
LINEAGE_KEEP = [*TAB, "row_no"]
ORDER = ["file_seq", "path", "tab_seq", "tab"]


@dataclass
class RunConfig:
    run_id: str
    as_of: str                   # fixed run time 'yyyy-MM-dd HH:mm:ss'
    locker_path: str
    quarantine_path: str
    errors_path: str
    events_path: str
    generated_keys: bool = True  # insert tabs without the key get max(key) + n


@dataclass
class Shape:
    """Tabs with the same target, mode, header and key column whose rows reach the table."""

    mode: str
    header: tuple[str, ...]
    key: str | None
    accepted: DataFrame | None = field(default=None)


def _write_dynamic(df: DataFrame, path: str, partition_by: list[str]) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def _auto_edit(settings: DataFrame | None, tables: list[str]) -> dict[str, bool]:
    """Whether each table's edit stamp is on (metadata: one row per table)."""
    out = dict.fromkeys(tables, DEFAULT_AUTO_EDIT)
    if settings is not None and tables:
        out |= {r[0]: bool(r[1]) for r in settings.where(F.col("target_table").isin(tables)).select("target_table", "auto_edit").collect()}
    return out


def read_quarantine(spark: SparkSession, cfg: RunConfig) -> DataFrame:
    """The run's rejected rows; an empty frame if it has none."""
    if not fs.exists(spark, cfg.quarantine_path):
        return spark.createDataFrame([], QUARANTINE_SCHEMA)
    q = spark.read.schema(QUARANTINE_SCHEMA).parquet(cfg.quarantine_path)
    return q.where(F.col("run_id") == cfg.run_id)


def run(spark: SparkSession, parsed: DataFrame, catalog: Catalog, store: TableStore, cfg: RunConfig,
        settings: DataFrame | None = None) -> DataFrame:
    """Apply ``parsed`` (path, tab, tab_seq, row_no, cells, authors, file_seq) and return the run's events."""
    if fs.exists(spark, cfg.locker_path):
        L.purge_written(spark, cfg.locker_path, settings, cfg.as_of)       # E4: at the start of every run
    parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
    # texts as group keys: an aggregate that holds texts would sort all rows
    order = parsed.groupBy("path", "tab", "authors").agg(F.min("file_seq").alias("file_seq"), F.min("tab_seq").alias("tab_seq"))
    order = order.groupBy("path", "tab").agg(F.min("file_seq").alias("file_seq"), F.min("tab_seq").alias("tab_seq"),
                                             F.max("authors").alias("authors"))
    env = EV.envelopes(parsed).join(order, ["path", "tab"])
    gates = tab_gates(env, catalog).select("path", "tab", "mode", "gate_id", "key_column")
    tabs = env.join(gates, ["path", "tab"]).persist(StorageLevel.MEMORY_AND_DISK)
    places = _places(parsed.where("row_no > 2").withColumn("chunk", EV.chunk()), tabs, catalog)
    events = run_rows(spark, tabs, EV.split_rows(parsed, places.withColumn("_header", F.col("header"))), catalog, store, cfg, settings)
    for df in (places, tabs, parsed):
        df.unpersist()
    return events


def _places(rows: DataFrame, tabs: DataFrame, catalog: Catalog) -> DataFrame:
    """What the rows of a tab need of it, with its columns' facts, once for each chunk of its rows: no task holds a whole tab.

    It is made at once, so that Spark plans the join by its true size."""
    places = EV.by_chunk(rows, tabs.join(tab_facts(tabs, catalog), ["path", "tab"])).persist(StorageLevel.MEMORY_AND_DISK)
    places.count()
    return places


def run_batch(spark: SparkSession, batch: DataFrame, catalog: Catalog, store: TableStore, cfg: RunConfig,
              settings: DataFrame | None = None) -> DataFrame:
    """A large batch that arrives as a table (Parquet, JDBC, flattened XML): the lineage columns TAB, target_table and
    row_no, and one text column per header cell; every tab has all of them."""
    header = [c for c in batch.columns if c not in (*LINEAGE_KEEP, "target_table")]
    names = F.array(*[F.lit(h) for h in header])
    batch = batch.withColumn("_chunk", EV.chunk())
    chunks = batch.groupBy("path", "tab", "target_table", "authors", F.col("_chunk").alias("chunk")).agg(
        F.min("file_seq").alias("file_seq"), F.min("tab_seq").alias("tab_seq"), F.count(F.lit(1)).alias("n_rows"))
    chunks = chunks.persist(StorageLevel.MEMORY_AND_DISK)
    env = chunks.groupBy("path", "tab").agg(
        F.min("target_table").alias("target_table"), F.min("file_seq").alias("file_seq"), F.min("tab_seq").alias("tab_seq"),
        F.max("authors").alias("authors"), F.sum("n_rows").alias("n_rows")).withColumn("header", names)
    tabs = env.join(tab_gates(env, catalog).select("path", "tab", "mode", "gate_id", "key_column"), ["path", "tab"])
    tabs = tabs.persist(StorageLevel.MEMORY_AND_DISK)
    places = _places(chunks, tabs, catalog)
    rows = batch.select("path", "tab", F.col("_chunk").alias("chunk"), "row_no", Q.row_map(header).alias("row")).join(
        places.withColumnRenamed("header", "_header").drop("n_rows"), ["path", "tab", "chunk"]).drop("chunk")
    events = run_rows(spark, tabs, rows, catalog, store, cfg, settings)
    for df in (places, tabs, chunks):
        df.unpersist()
    return events


def run_rows(spark: SparkSession, tabs: DataFrame, rows: DataFrame, catalog: Catalog, store: TableStore, cfg: RunConfig,
             settings: DataFrame | None = None) -> DataFrame:
    """The run over judged tabs (one row each: TAB, target_table, header, mode, gate_id, key_column, n_rows) and their
    data rows (TAB, target_table, mode, gate_id, key_column, _header, _cells, row_no, row map)."""
    looked = ~_stopped()
    # all rows of all tables are judged in one plan; what a table's keys reject (D2) is found with its changes
    judged = _written(judge(rows.where(looked)))
    _write_dynamic(_gated(tabs, rows, cfg.run_id).unionByName(_rejected(judged, cfg.run_id)), cfg.quarantine_path, ["run_id", "part"])
    shapes: dict[str, list[Shape]] = {}
    for r in tabs.where(looked & F.col("gate_id").isNull()).select("target_table", "mode", "header", "key_column").distinct().collect():
        shapes.setdefault(r["target_table"], []).append(Shape(r["mode"], tuple(r["header"]), r["key_column"]))
    specs, stamped = catalog.specs(sorted(shapes)), _auto_edit(settings, sorted(shapes))
    for table in sorted(shapes):
        if not store.applied(table, f"{cfg.run_id}:{table}"):
            mine = sorted(shapes[table], key=lambda s: (s.mode, s.header))
            _run_table(spark, specs[table], mine, judged, store, cfg, stamped[table])
    quarantine = read_quarantine(spark, cfg)
    _write_dynamic(Q.error_details(quarantine).withColumn("run_id", F.lit(cfg.run_id)), cfg.errors_path, ["run_id"])
    _write_dynamic(_events(tabs, quarantine, cfg), cfg.events_path, ["run_id"])
    events = spark.read.schema(EVENTS_SCHEMA).parquet(cfg.events_path).where(F.col("run_id") == cfg.run_id)
    return events.select("run_id", "event_time", "level", "message")


def _written(judged: DataFrame) -> DataFrame:
    """Judged rows as files by target table: a table's part is read by itself, and no later plan holds the rules."""
    path = scratch_dir(judged.sparkSession, "judged")
    judged.write.partitionBy("target_table").parquet(path)
    last = [f for f in judged.schema if f.name == "target_table"]
    return judged.sparkSession.read.schema(StructType([*(f for f in judged.schema if f.name != "target_table"), *last])).parquet(path)


def _stopped() -> Column:
    """Tabs that no column of their target is looked at for."""
    return F.coalesce(F.col("gate_id").isin(*R.TAB_GATES_HEAD), F.lit(False))


def _gated(tabs: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """Rows of the tabs that a gate stops at once; one without rows leaves a line without a row number."""
    empty = F.expr("cast(map() as map<string,string>)")
    lost = rows.where(_stopped()).select(*TAB, "target_table", "gate_id", "row_no", "row").unionByName(
        tabs.where(_stopped() & (F.col("n_rows") == 0)).select(
            *TAB, "target_table", "gate_id", F.lit(None).cast("bigint").alias("row_no"), empty.alias("row")))
    texts = F.create_map(*[x for k, v in R.RULE_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return lost.select(F.col("path").alias("file"), F.col("authors").cast("string").alias("authors"), "tab", "target_table",
                       "row_no", "row", F.lit(None).cast("string").alias("rule_column"), F.col("gate_id").alias("rule_id"),
                       texts[F.col("gate_id")].alias("rule_message"), F.lit(run_id).alias("run_id"), F.lit(GATED).alias("part"))


def _events(tabs: DataFrame, quarantine: DataFrame, cfg: RunConfig) -> DataFrame:
    """One event per tab, from what the run has written."""
    bad = quarantine.groupBy(F.col("file").alias("path"), "tab").agg(
        F.count("row_no").alias("rejected"), F.count(F.lit(1)).alias("lines"))
    t = tabs.join(bad, ["path", "tab"], "left")
    n = F.coalesce("rejected", F.lit(0))
    level = F.when(F.coalesce("lines", F.lit(0)) > 0, "warning").otherwise("info")
    text = F.concat(F.coalesce("mode", F.lit("unknown")), F.lit(" tab "), F.col("tab"), F.lit(" of "), S.base_name("path"),
                    F.lit(" for "), F.coalesce("target_table", F.lit("no table")), F.lit(": "),
                    (F.col("n_rows") - n).cast("string"), F.lit(" applied, "), n.cast("string"), F.lit(" rejected"),
                    F.coalesce(F.concat(F.lit(" ("), F.col("gate_id"), F.lit(")")), F.lit("")))
    return t.select(F.lit(cfg.run_id).alias("run_id"), F.lit(cfg.as_of).cast("timestamp_ntz").alias("event_time"),
                    level.alias("level"), text.alias("message"))


def _rejected(judged: DataFrame, run_id: str) -> DataFrame:
    return judged.where("rule_id is not null").select(
        F.col("path").alias("file"), F.col("authors").cast("string").alias("authors"), "tab", "target_table", "row_no", "row",
        "rule_column", "rule_id", "rule_message", F.lit(run_id).alias("run_id"), F.col("target_table").alias("part"))


def _accepted(judged: DataFrame, spec: TableSpec, shape: Shape) -> DataFrame:
    """The accepted rows of one shape, typed as the table is; lineage names that a header may also use are set aside."""
    mine = judged.where(F.col("rule_id").isNull() & (F.col("target_table") == spec.table) & (F.col("mode") == shape.mode)
                        & F.col("key_column").eqNullSafe(F.lit(shape.key)) & (F.col("_header") == F.array(*[F.lit(h) for h in shape.header])))
    batch = mine.select(*[F.col(c).alias(f"_l_{c}") for c in LINEAGE_KEEP], *[F.col("row")[h].alias(h) for h in shape.header])
    return A.typed(batch, spec, shape.header, keep=tuple(f"_l_{c}" for c in LINEAGE_KEEP))


def _run_table(spark: SparkSession, spec: TableSpec, shapes: list[Shape], judged: DataFrame, store: TableStore,
               cfg: RunConfig, auto_edit: bool) -> None:
    """All of a run's tabs for one table: look up keys, preserve, commit once."""
    table, held, missing = spec.table, [], None
    for shape in shapes:
        shape.accepted = A.edit_stamp(_accepted(judged, spec, shape), spec, auto_edit, cfg.as_of)
    inserted = _inserted([s for s in shapes if s.mode == "insert"], table, spec, store, cfg)
    updates = [s for s in shapes if s.mode == "update"]
    lockers, finals, replaced = [], [], []
    if inserted is not None:
        new_rows, payload = inserted
        new_rows = new_rows.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(new_rows)
        lockers.append(L.locker_rows_by_tab(_lineage(new_rows, payload), target_table=table, run_id=cfg.run_id, mode="Insert",
                                            as_of=cfg.as_of, row=_own(Q.row_map([f"_p_{c}" for c in payload], payload))))
        finals.append(A.insert_columns(new_rows.select(*payload), store.schema(table), spec))
    if updates:
        changes, missing, hits = _changes(table, spec, updates, store, inserted, cfg.run_id)
        held += hits
        changes = changes.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(changes)
        lockers.append(_before_images(changes, table, cfg))
        final = _final_values(changes, spec)
        replaced = [r[0] for r in changes.where("_born is null").select(PART).distinct().collect()]  # partitions
        target = [store.read(table, replaced)] if replaced else []
        finals = [_with_values(df, final, spec) for df in [*target, *finals]]
    if missing is not None:
        _write_dynamic(missing, cfg.quarantine_path, ["run_id", "part"])
    if lockers:
        L.append(reduce(DataFrame.unionByName, lockers), cfg.locker_path)
    if finals:
        # before images and rejects are on disk; only now does the table change
        store.commit(table, reduce(DataFrame.unionByName, finals), replaced, f"{cfg.run_id}:{table}")
    for df in held:
        df.unpersist()


def _lineage(df: DataFrame, payload: list[str]) -> DataFrame:
    return df.select(*[F.col(f"_l_{c}").alias(c) for c in LINEAGE_KEEP], "_set",
                     *[F.col(f"`{c}`").alias(f"_p_{c}") for c in payload])


def _own(row: Column, key: str | None = None) -> Column:
    """Of a row map, the key and the columns that the row's own tab has."""
    def own(k: Column, _: Column) -> Column:
        return F.array_contains("_set", k) if key is None else (k == key) | F.array_contains("_set", k)

    return F.map_filter(row, own)


def _inserted(shapes: list[Shape], table: str, spec, store: TableStore, cfg: RunConfig) -> tuple[DataFrame, list[str]] | None:
    """Accepted rows of the insert tabs, in order, with generated keys; and their columns."""
    if not shapes:
        return None
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_with_set(s.accepted) for s in shapes])
    payload = [c for c in rows.columns if not c.startswith("_l_") and c != "_set"]
    pk = spec.primary_key
    if cfg.generated_keys and len(pk) == 1 and pk[0] not in payload:
        base = store.read(table).agg(F.max(pk[0])).first()[0] or 0      # one scalar
        rows = A.sequence_keys(rows, pk[0], int(base), [f"_l_{c}" for c in [*ORDER, "row_no"]])
        rows = rows.withColumn("_set", F.concat(F.array(F.lit(pk[0])), "_set"))
        payload = [pk[0], *payload]
    return rows, payload


def _with_set(rows: DataFrame, key: str | None = None) -> DataFrame:
    """The names of the columns that these rows' tab gives, besides its key."""
    return rows.withColumn("_set", F.array(*[F.lit(c) for c in rows.columns if not c.startswith("_l_") and c != key]))


def _sequence(prefix: str = "_l_") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ORDER])


def _changes(table: str, spec, shapes: list[Shape], store: TableStore, inserted,
             run_id: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Each change of a target row by a tab, with the row's old values and partition; the D2 rejects; what is persisted.

    The target is scanned once for each key column that the tabs use (as a rule one): key ranges reach the
    Parquet scan, a bit array drops other rows before the shuffle, and a semi join
    keeps the rows that some accepted row names, by whole keys or by one column of a wider key.
    Rows that an earlier tab of this run inserts can be named too."""
    pk = spec.primary_key
    columns = sorted({c for s in shapes for c in s.accepted.columns if not c.startswith("_l_") and c != _key(spec, s)})
    schema, part_col = store.schema(table), store.partition_column(table)
    needed = list(dict.fromkeys([*pk, *columns]))
    view = store.read(table).withColumn(PART, part_key(part_col)).withColumn("_born", F.lit(None).cast(
        "struct<file_seq:bigint,path:string,tab_seq:int,tab:string>"))
    view = view.select(*needed, PART, "_born")
    if inserted is not None:
        new = schema.names
        rows = inserted[0].withColumn("_born", _sequence().cast("struct<file_seq:bigint,path:string,tab_seq:int,tab:string>"))
        view = view.unionByName(rows.select(
            *[(F.col(c) if c in inserted[1] else A.unlisted(c, spec)).cast(schema[c].dataType).alias(c) for c in new if c in needed],
            F.lit("new").alias(PART), "_born"))
    found, missing, held = [], [], []
    for key in sorted({_key(spec, s) for s in shapes}):
        mine = [s for s in shapes if _key(spec, s) == key]
        batch = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
            _with_set(s.accepted, key) for s in mine]).persist(StorageLevel.MEMORY_AND_DISK)      # cells are cast once
        held.append(batch)
        # keys meet as the column's collation compares them; the target's rows are looked up by ranges and bits of the batch's keys
        collation = spec.column(key).collation
        alike = A.compared(F.col(key), collation).alias(A.COMPARED)
        hits = A.existing_keys(view, batch, key, collation) if collation else touched(view, batch.select(key), key)
        hits = hits.select("*", alike).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(hits)
        seq = _sequence().cast("struct<file_seq:bigint,path:string,tab_seq:int,tab:string>")
        # present: in the target, or inserted by an earlier tab (only inserted rows have a place in the run)
        there = hits.groupBy(A.COMPARED).agg(F.min("_born").alias("_first"), F.max(F.col("_born").isNull()).alias("_old"))
        judged = batch.select("*", alike).join(there, A.COMPARED, "left").withColumn(
            "_ok", F.coalesce(F.col("_old") | (F.col("_first") < seq), F.lit(False)))
        payload = [c for c in batch.columns if not c.startswith("_l_") and c != "_set"]
        missing.append(judged.where("not _ok").select(
            F.col("_l_path").alias("file"), F.col("_l_authors").cast("string").alias("authors"), F.col("_l_tab").alias("tab"),
            F.lit(table).alias("target_table"), F.col("_l_row_no").alias("row_no"),
            _own(Q.row_map(payload), key).alias("row"),
            F.lit(key).alias("rule_column"), F.lit("D2").alias("rule_id"), F.lit(R.RULE_TEXT["D2"]).alias("rule_message"),
            F.lit(run_id).alias("run_id"), F.lit(f"{table} {KEYS}").alias("part")))
        # one change per (tab, key): the tab's last row
        values = [c for c in payload if c != key]
        last = F.max_by(F.struct("_l_row_no", "_l_authors", "_set", *[F.col(c).alias(f"_n_{c}") for c in values]), "_l_row_no")
        one = (judged.where("_ok").groupBy(A.COMPARED, *[f"_l_{c}" for c in ORDER]).agg(last.alias("_w"))
               .select(A.COMPARED, *[f"_l_{c}" for c in ORDER], "_w.*"))
        for c in columns:
            if c not in values:
                one = one.withColumn(f"_n_{c}", F.lit(None).cast(schema[c].dataType))
        old = hits.select(*[F.col(c).alias(f"_o_{c}") for c in needed], F.col(key).cast("string").alias("_key_text"), A.COMPARED, PART, "_born")
        found.append(one.join(old, A.COMPARED).where(F.col("_born").isNull() | (F.col("_born") < seq))
                     .withColumn("_key", F.lit(key)))
    # under one key, rows that are one target row already lie together by it
    together = [A.COMPARED] if len(found) == 1 else []
    changes = found[0] if together else reduce(DataFrame.unionByName, [f.drop(A.COMPARED) for f in found])
    # all columns by one window: a window each would sort and copy the rows once for every column
    w = Window.partitionBy(*together, *[f"_o_{c}" for c in pk]).orderBy(*[f"_l_{c}" for c in ORDER])
    given = {c: F.when(F.array_contains("_set", c), F.struct(F.col(f"_n_{c}").alias("v"))) for c in columns}
    changes = changes.select("*", *[g.alias(f"_g_{c}") for c, g in given.items()]).select(
        "*", F.lead(F.lit(True)).over(w).isNull().alias("_latest"),
        *[F.last(f"_g_{c}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_p_{c}") for c in columns])
    changes = changes.select(
        *[f"_l_{c}" for c in LINEAGE_KEEP], "_set", "_key", "_key_text", PART, "_born", "_latest", *[f"_o_{c}" for c in pk],
        *[F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}")["v"]).otherwise(F.col(f"_o_{c}")).alias(f"_b_{c}") for c in columns],
        *[F.coalesce(f"_g_{c}", f"_p_{c}").alias(f"_a_{c}") for c in columns])
    return changes, reduce(DataFrame.unionByName, missing), held


def _key(spec, shape: Shape) -> str:
    return spec.column(shape.key).name


def _before_images(changes: DataFrame, table: str, cfg: RunConfig) -> DataFrame:
    """What each change replaces: the key and the columns of the tab that makes it."""
    columns = [c[3:] for c in changes.columns if c.startswith("_b_")]
    row = F.map_concat(F.map_from_arrays(F.array("_key"), F.array("_key_text")), _own(Q.row_map([f"_b_{c}" for c in columns], columns)))
    image = changes.select(*[F.col(f"_l_{c}").alias(c) for c in ["path", "tab", "authors", "row_no"]], row.alias("_row"))
    return L.locker_rows_by_tab(image, target_table=table, run_id=cfg.run_id, mode="Update", as_of=cfg.as_of, row=F.col("_row"))


def _final_values(changes: DataFrame, spec) -> DataFrame:
    """One row per changed target row: its primary key and, for each column some tab set, the last value."""
    after = [c for c in changes.columns if c.startswith("_a_")]
    return changes.where("_latest").select(*[F.col(f"_o_{c}").alias(f"_k_{c}") for c in spec.primary_key], *after)


def _with_values(rows: DataFrame, final: DataFrame, spec) -> DataFrame:
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in spec.primary_key])
    joined = rows.join(final, on, "left")
    given = {c[3:] for c in final.columns if c.startswith("_a_")}
    return joined.select(*[
        (F.when(F.col(f"_a_{c}").isNotNull(), F.col(f"_a_{c}")["v"]).otherwise(F.col(c)) if c in given else F.col(c))
        .cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


def run_inbox(spark: SparkSession, inbox: str, catalog: Catalog, store: TableStore, cfg: RunConfig,
              settings: DataFrame | None = None, archive: str | None = None) -> DataFrame:
    """Batch entry: every file of the inbox in one run; then the files move to ``archive``."""
    from ..sources.workbook import csv_part, inbox_files, read_inbox

    files = inbox_files(spark, inbox)
    events = run(spark, _with_file_order(read_inbox(spark, inbox)), catalog, store, cfg, settings)
    if archive:
        for path in files:
            name = "/".join(path.rsplit("/", 2 if csv_part(path) else 1)[1:])      # a part keeps its folder
            fs.rename(spark, path, f"{archive.rstrip('/')}/{cfg.run_id}/{name}")
    return events


def _with_file_order(parsed: DataFrame) -> DataFrame:
    """file_seq = the file's modification time in microseconds; ties are ordered by path.

    A per-row expression: no window over the file list, however many files arrive."""
    out = parsed.withColumn("file_seq", F.unix_micros(F.col("modificationTime")))
    return out.withColumn("authors", S.authors_text("authors"))
