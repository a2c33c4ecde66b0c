"""Rules as data: V1-V15, C6, the gates and V14 for the tabs of all tables in one plan.

:mod:`.rules` compiles one table's rules to one projection, so a batch over many tables is as many
plans.  Here the catalog stays a table.  A column's facts (family, limits, length,
precision, scale, nullability) become a struct, a tab's header an array of such structs by one join
per tab, and one expression judges any cell by its struct.  The first cell that fails, in header
order, is the row's reject, as in the chain; gates and the key come before and after it.

The number of plans and jobs depends neither on tables nor on headers, and nothing of the catalog reaches
the driver.  A row meets its tab's facts in one equi join on the tab, whose small side holds one row
per tab; a tab with very many rows is a skewed key of an inner join, which AQE splits.  Cells are judged inside
their row, so no cell is ever shuffled.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.types import DATETIME_TYPES, INTEGER_LIMITS, INTEGER_TYPES, NUMERIC_LIMITS, NUMERIC_TYPES, TEXT_TYPES
from .catalog import Catalog, by_shuffle
from .rules import RULE_TEXT, TAB_GATES_HEAD, TAB_GATES_KEY

MAX_PRECISION = 38
TYPE_SCHEMA = ("_type string, family string, floating boolean, declared_scale boolean, lo_long bigint, hi_long bigint, "
               "lo_exact decimal(38,10), hi_exact decimal(38,10), lo double, hi double")


def type_table(spark: SparkSession) -> DataFrame:
    """One row per declared type: its family and limits.  Limits beyond 28 digits are compared as doubles only."""
    rows = []
    for family, names in (("text", TEXT_TYPES), ("integer", INTEGER_TYPES), ("datetime", DATETIME_TYPES), ("numeric", NUMERIC_TYPES)):
        for t in names:
            lo, hi = INTEGER_LIMITS.get(t) or NUMERIC_LIMITS.get(t) or (None, None)
            longs = (lo, hi) if t in INTEGER_LIMITS else (None, None)
            exact = [Decimal(str(x)) if x is not None and abs(Decimal(str(x))) < Decimal(10) ** 28 else None for x in (lo, hi)]
            rows.append((t, "time" if t == "time" else family, t in ("float", "real"), t in ("decimal", "numeric"), *longs, *exact,
                         *(None if x is None else float(x) for x in (lo, hi))))
    return spark.createDataFrame(rows, TYPE_SCHEMA)


def column_facts(catalog: Catalog) -> DataFrame:
    """(_schema, _table, _facts): of each table, lower-case column name -> what its cells are judged by."""
    c = catalog.columns.withColumn("_type", F.lower("data_type"))
    typed = c.join(type_table(catalog.columns.sparkSession), "_type", "left")
    # 10^(precision - scale) as text: cells of a decimal stay below it
    room = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.col("numeric_precision") - F.coalesce("numeric_scale", F.lit(0))))
    facts = F.struct("_type", "family", "floating", "declared_scale", "lo_long", "hi_long", "lo_exact", "hi_exact", "lo", "hi",
                     (F.col("is_nullable") == "YES").alias("nullable"), F.col("char_max_len").alias("max_len"),
                     F.col("numeric_precision").alias("precision"), F.col("numeric_scale").alias("scale"), room.alias("room"))
    one = (typed.groupBy(F.col("table_schema").alias("_schema"), F.col("table_name").alias("_table"), F.lower("column_name").alias("_name"))
           .agg(F.min_by(facts, "ordinal").alias("_f")))
    return one.groupBy("_schema", "_table").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_f"))).alias("_facts"))


def tab_facts(tabs: DataFrame, catalog: Catalog) -> DataFrame:
    """(path, tab, _cells): a tab's header in order, each name with its column's facts, NULL if the table has no such column."""
    parts = F.split("target_table", "[.]")
    named = tabs.select("path", "tab", "header", F.when(S.is_schema_table("target_table"), parts[0]).alias("_schema"),
                        F.when(S.is_schema_table("target_table"), parts[1]).alias("_table"))
    known = named.join(by_shuffle(column_facts(catalog)), ["_schema", "_table"], "left")
    cells = F.transform("header", lambda h: F.struct(h.alias("name"), F.try_element_at("_facts", F.lower(h)).alias("facts")))
    return known.select("path", "tab", cells.alias("_cells"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _fits(text: Column, f: Column) -> Column:
    """Whether the value, rounded to the declared scale, has room in the declared precision."""
    scale = F.coalesce(f["scale"], F.lit(0))
    out = F.lit(True)
    for s in range(MAX_PRECISION, -1, -1):
        kind = f"decimal({MAX_PRECISION},{s})"
        value = text.try_cast(kind)
        room = f["room"].try_cast(kind)  # NULL where the precision is the type's whole
        out = F.when(scale == s, value.isNotNull() & F.coalesce(F.abs(value) < room, F.lit(True))).otherwise(out)
    return out


def _beyond(dec: Column, dbl: Column, exact: Column, limit: Column, above: bool) -> Column:
    def op(a: Column, b: Column) -> Column:
        return a > b if above else a < b

    return F.coalesce(op(dec, exact), op(dec.cast("double"), limit), op(dbl, limit))


def _too_long(c: Column, f: Column) -> Column:
    return (f["max_len"] > 0) & (F.length(c) > f["max_len"])


def _integer(c: Column, f: Column) -> Column:
    """Whole numbers that a long holds are settled by two comparisons; only the rest meet the grammar and the decimal."""
    def judged(text: Column) -> Column:
        slow = _let(text.try_cast("decimal(38,10)"), lambda dec: _let(
            F.when(dec.isNull(), text.try_cast("double")), lambda dbl: F.when(~S.is_number(c), "V2").when(~S.has_digit(c), "V3")
            .when(dec != F.floor(dec), "V3b").when(_beyond(dec, dbl, f["lo_exact"], f["lo"], False), "V4")
            .when(_beyond(dec, dbl, f["hi_exact"], f["hi"], True), "V5").when(_too_long(c, f), "V6")))
        return _let(F.when(S.is_plain(c), text.try_cast("bigint")), lambda n: F.when(
            n.isNotNull(), F.when(n < f["lo_long"], "V4").when(n > f["hi_long"], "V5").when(_too_long(c, f), "V6")).otherwise(slow))

    return _let(F.trim(c), judged)


def _numeric(c: Column, f: Column) -> Column:
    def judged(text: Column) -> Column:
        return _let(text.try_cast("decimal(38,10)"), lambda dec: _let(
            F.when(dec.isNull(), text.try_cast("double")),
            lambda dbl: F.when(~(S.is_plain(c) & dec.isNotNull() | S.is_number(c) | (f["floating"] & c.rlike(S.NON_FINITE_PATTERN))), "V8")
            .when(_beyond(dec, dbl, f["lo_exact"], f["lo"], False), "V9").when(_beyond(dec, dbl, f["hi_exact"], f["hi"], True), "V10")
            .when((F.length(c) > f["precision"]) & (S.integer_digits(c) > f["precision"]), "V11")
            .when(f["declared_scale"] & (F.instr(c, ".") > 0) & (F.length(c) - F.instr(c, ".") > f["scale"]) & (S.fraction_digits(c) > f["scale"]), "V15")
            .when(f["declared_scale"] & f["precision"].isNotNull() & ~_fits(text, f), "V15b")))

    return _let(F.trim(c), judged)


def cell_rule(c: Column, f: Column, is_key: Column) -> Column:
    """The first rule that cell ``c`` fails by its column's facts ``f``; NULL if it is fine.  An update's key may be NULL here."""
    by_family = (F.when(f["family"] == "text", F.when(_too_long(c, f), "V1"))
                 .when(f["family"] == "integer", _integer(c, f))
                 .when(f["family"] == "numeric", _numeric(c, f))
                 .when(f["family"] == "datetime", F.when(S.parse_datetime(c).isNull(), "V7"))
                 .when(f["family"] == "time", F.when(~S.is_time(c), "V7")))
    return F.when(c.isNotNull(), by_family).when(~f["nullable"] & ~is_key, "V12")


def validate_tables(rows: DataFrame, tabs: DataFrame, catalog: Catalog) -> DataFrame:
    """``rows`` (path, tab, mode, gate_id, key_column, row map) with rule_id, rule_column and rule_message; NULL is accepted.

    ``tabs`` has one row per (path, tab): target_table and header.  Rows may belong to any number of tables."""
    return judge(rows.join(tab_facts(tabs, catalog), ["path", "tab"]))


def judge(rows: DataFrame) -> DataFrame:
    """``validate_tables`` for rows that have their tab's facts (``_cells``, see ``tab_facts``) with them."""
    key, update = F.col("key_column"), F.col("mode") == "update"
    entries = F.map_entries("row")

    def cell(entry: Column, name: Column) -> Column:
        # a row's map keeps its header's order; a look-up only where it doesn't
        return F.when(entry["key"] == name, entry["value"]).otherwise(F.element_at(F.col("row"), name))

    def judged(s: Column, i: Column, cells: Column) -> Column:
        facts = s["facts"]
        own_key = update & F.coalesce(F.lower(s["name"]) == F.lower(key), F.lit(False))
        rule = F.when(facts.isNull(), "C6").otherwise(_let(cell(F.get(cells, i), s["name"]), lambda c: cell_rule(c, facts, own_key)))
        # nothing is made for a cell that is fine
        return _let(rule, lambda r: F.when(r.isNotNull(), F.struct(
            r.alias("rule_id"), s["name"].alias("rule_column"), F.when(facts.isNotNull(), facts["_type"]).alias("data_type"))))

    failed = _let(entries, lambda cells: F.filter(F.transform("_cells", lambda s, i: judged(s, i, cells)), lambda r: r.isNotNull()))
    gate, none = F.col("gate_id"), F.lit(None).cast("string")

    def reject(rule_id: Column, column: Column = none, data_type: Column = none) -> Column:
        return F.struct(rule_id.alias("rule_id"), column.alias("rule_column"), data_type.alias("data_type"))

    first = _let(F.get(failed, F.lit(0)), lambda f: F.when(f.isNotNull(), f).when(gate.isin(*TAB_GATES_KEY), reject(gate)).when(
        update & key.isNotNull() & F.element_at(F.col("row"), key).isNull(), reject(F.lit("V13"), key)))
    # as in the chain: filters on the outcome stay above, so that no cell is judged twice
    barrier = F.spark_partition_id() >= 0
    outcome = F.when(barrier, F.when(gate.isin(*TAB_GATES_HEAD), reject(gate)).otherwise(first))
    texts = F.create_map(*[x for k, v in RULE_TEXT.items() for x in (F.lit(k), F.lit(v))])
    rule = F.col("_reject")
    message = F.concat(texts[rule["rule_id"]], F.coalesce(F.concat(F.lit(" ("), rule["data_type"], F.lit(")")), F.lit("")))
    return rows.withColumn("_reject", outcome).select(
        *[c for c in rows.columns if c != "_cells"], rule["rule_id"].alias("rule_id"), rule["rule_column"].alias("rule_column"), message.alias("rule_message"))
