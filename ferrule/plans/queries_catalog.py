"""Registered queries: catalog lookups, tab gates, envelopes, NULL tokens, headers, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gates as G
from ..operators import quarantine as Q
from ..sources import envelope as EV
from . import fixtures as X
from .registry import register


def _cat_ctes() -> str:
    c = X.tenant_catalog_sql()
    return (f"ct AS ({c['tables']}),\ncc AS ({c['columns']}),\nck AS ({c['keys']}),\n"
            f"pk AS (SELECT DISTINCT k.schema AS table_schema, k.table_name, k.column_name FROM "
            f"(SELECT DISTINCT catalog, schema, table_name, constraint_name, constraint_type FROM ck) c "
            f"JOIN ck k ON c.table_name = k.table_name AND c.catalog = k.catalog AND c.schema = k.schema "
            f"AND c.constraint_name = k.constraint_name WHERE c.constraint_type = 'PRIMARY KEY')")


# --- A8/D5, A9 -----------------------------------------------------------------------------------

@register("primary_keys", lambda: f"WITH {_cat_ctes()}\nSELECT table_schema, table_name, column_name FROM pk")
def primary_keys(spark: SparkSession, sf: str) -> DataFrame:
    return X.tenant_catalog(spark, sf).primary_keys()


@register("user_tables", lambda: f"WITH {_cat_ctes()}\nSELECT table_schema, table_name FROM ct "
                                 f"WHERE NOT contains(lower(table_name), 'msys')")
def user_tables(spark: SparkSession, sf: str) -> DataFrame:
    return X.tenant_catalog(spark, sf).user_tables()


# --- C1-C11 over every tab -------------------------------------------------------------------------

def _gates_sql() -> str:
    """By hand: which gate each of the twelve kinds of tab is built to fail (FIXTURES.md, tab list)."""
    return f"""WITH e AS (
  SELECT *, regexp_extract(tab, '_([0-9]+)$', 1)::BIGINT AS k, regexp_extract(tab, '^(.*_)[0-9]+$', 1) AS kind
  FROM ({X.gate_envelopes_sql()})),
r AS (SELECT tab, target_table, n_rows, kind,
  CASE WHEN kind = 'notes_' THEN NULL WHEN starts_with(kind, 'Insert') THEN 'insert' ELSE 'update' END AS mode,
  CASE WHEN kind = 'notes_' THEN 'C1' WHEN kind = 'Update_d_' THEN 'C2' WHEN kind = 'Update_e_' THEN 'C3' WHEN n_rows = 0 THEN 'C4'
       WHEN ends_with(target_table, '.orders') AND k % 11 = 0 THEN 'C5' WHEN kind = 'Update_k_' THEN 'C6' WHEN kind = 'Insert_f_' THEN 'C8'
       WHEN kind = 'Update_g_' THEN 'C9' WHEN kind = 'Update_h_' THEN 'C10' WHEN kind = 'Update_i_' THEN 'C11' END AS gate_id FROM e)
SELECT tab, target_table, mode, n_rows, gate_id,
  CASE WHEN gate_id IS NULL AND kind = 'Update_a_' THEN 'O_OrderKey' WHEN gate_id IS NULL AND mode = 'update' THEN 'o_orderkey' END AS key_column
FROM r"""


@register("tab_gates", _gates_sql)
def tab_gates(spark: SparkSession, sf: str) -> DataFrame:
    return G.tab_gates(X.gate_envelopes(spark, sf), X.tenant_catalog(spark, sf))


# --- A7: header cells resolved against the catalog ------------------------------------------------------

def _columns_catalog_sql() -> str:
    return f"""WITH {_cat_ctes()},
e AS (SELECT tab, target_table, split_part(target_table, '.', 1) AS _schema, split_part(target_table, '.', 2) AS _table,
             unnest(generate_series(0, len(header) - 1)) AS position, unnest(header) AS header_name
      FROM ({X.gate_envelopes_sql()}) WHERE {S.is_schema_table_sql('target_table')})
SELECT tab, target_table, CAST(position AS BIGINT) AS position, header_name, cc.column_name, cc.data_type,
       cc.is_nullable, cc.char_max_len, cc.numeric_precision, cc.numeric_scale
FROM e LEFT JOIN cc ON cc.table_schema = e._schema AND cc.table_name = e._table
                    AND lower(cc.column_name) = lower(e.header_name)"""


@register("columns_catalog", _columns_catalog_sql)
def columns_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return G.resolve_header(X.gate_envelopes(spark, sf), X.tenant_catalog(spark, sf))


# --- A16, A3/C16, A15 -------------------------------------------------------------------------------------

def _header_ctes() -> str:
    return f"""sc AS ({X.sheet_cells_sql()}),
h0 AS (SELECT path, tab, unnest(generate_series(0, len(cells) - 1)) AS position, unnest(cells) AS raw_name
       FROM sc WHERE row_no = 2),
h1 AS (SELECT *, CASE WHEN raw_name IS NULL OR trim(raw_name) = '' THEN 'Unnamed: ' || CAST(position AS VARCHAR)
                      ELSE trim(raw_name) END AS _base FROM h0),
hn AS (SELECT path, tab, CAST(position AS BIGINT) AS position, raw_name,
              CASE WHEN row_number() OVER (PARTITION BY path, tab, _base ORDER BY position) = 1 THEN _base
                   ELSE _base || '.' || CAST(row_number() OVER (PARTITION BY path, tab, _base ORDER BY position) - 1 AS VARCHAR)
              END AS resolved_name FROM h1)"""


@register("header_names", lambda: f"WITH {_header_ctes()}\nSELECT * FROM hn")
def header_names(spark: SparkSession, sf: str) -> DataFrame:
    return EV.header_cells(X.sheet_cells(spark, sf))


TOKENS_SQL = ", ".join(S.sql_str(t) for t in S.NULL_TOKENS)
NORM_SQL = f"list_transform(cells, lambda x: CASE WHEN x NOT IN ({TOKENS_SQL}) THEN x END)"


def _split_sql() -> str:
    return f"""WITH {_header_ctes()},
tabs AS (SELECT path, tab, max(CASE WHEN row_no = 1 THEN trim(cells[1]) END) AS target_table,
                max(CASE WHEN row_no > 2 THEN len(cells) ELSE 0 END) AS width FROM sc GROUP BY ALL),
named AS (SELECT path, tab, list(resolved_name ORDER BY position) AS h FROM hn GROUP BY ALL),
env AS (SELECT path, tab, target_table,
               list_concat(h, ['Unnamed: ' || i FOR i IN range(len(h), greatest(width, len(h)))]) AS header
        FROM tabs JOIN named USING (path, tab))
SELECT d.path, d.tab, env.target_table, d.row_no,
  array_to_string(list_transform(list_sort(list_zip(env.header, list_resize({NORM_SQL}, len(env.header), NULL))),
                  lambda e: e[1] || '=' || coalesce(e[2], '{Q.NULL_MARK}')), ';') AS row_text
FROM sc d JOIN env ON d.path = env.path AND d.tab = env.tab WHERE d.row_no > 2"""


@register("envelope_split", _split_sql)
def envelope_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = EV.split_rows(X.sheet_cells(spark, sf))
    return rows.withColumn("row_text", Q.map_text("row")).drop("row")


@register("null_tokens", f"""WITH sc AS ({X.sheet_cells_sql()})
SELECT path, tab, row_no, array_to_string(list_transform({NORM_SQL}, lambda x: coalesce(x, '{Q.NULL_MARK}')), '|') AS cells_text,
  CAST(len(list_filter({NORM_SQL}, lambda x: x IS NULL)) AS BIGINT) AS n_null
FROM sc WHERE row_no > 2""")
def null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = X.sheet_cells(spark, sf).where(F.col("row_no") > 2).withColumn("_n", EV.normalize_cells("cells"))
    return d.select("path", "tab", "row_no",
                    F.array_join(F.transform("_n", lambda x: F.coalesce(x, F.lit(Q.NULL_MARK))), "|").alias("cells_text"),
                    F.size(F.filter("_n", lambda x: x.isNull())).cast("bigint").alias("n_null"))


# --- S1-S10, S13 over every cell of the dirty batch --------------------------------------------------------

def _scalars_sql() -> str:
    cells = ", ".join("{" + f"'column_name': '{h}', 'value': \"{h}\"" + "}" for h in X.UPDATE_ORDERS_HEADER)
    v = "value"
    return f"""WITH b AS ({X.UPDATE_ORDERS_SQL}),
u AS (SELECT row_no, file, tab, target_table, unnest([{cells}], recursive := true) FROM b)
SELECT row_no, column_name, value,
  coalesce({S.is_number_sql(v)}, FALSE) AS is_number, coalesce({S.is_number_sql(v, True)}, FALSE) AS is_float_text,
  coalesce({S.has_digit_sql(v)}, FALSE) AS has_digit,
  {S.text_length_sql(v)} AS text_length, {S.integer_digits_sql(v)} AS integer_digits,
  {S.fraction_digits_sql(v)} AS fraction_digits, {S.day_key_sql(S.parse_datetime_sql(v))} AS day_key,
  {S.base_name_sql('file')} AS file_name, {S.extension_sql('file')} AS file_ext, {S.mode_of_tab_sql('tab')} AS mode,
  {S.is_schema_table_sql('target_table')} AS table_ok, split_part(target_table, '.', 1) AS table_schema,
  CASE row_no % 4 WHEN 0 THEN 'Ann, Bob' WHEN 1 THEN 'Ann' WHEN 2 THEN 'Bob' END AS authors
FROM u"""


@register("scalars", _scalars_sql)
def scalars(spark: SparkSession, sf: str) -> DataFrame:
    b = X.update_orders(spark, sf)
    cells = F.array(*[F.struct(F.lit(h).alias("column_name"), F.col(h).alias("value")) for h in X.UPDATE_ORDERS_HEADER])
    u = b.select("row_no", "file", "tab", "target_table", F.explode(cells).alias("c")).select(
        "row_no", "file", "tab", "target_table", "c.column_name", "c.value")
    v = F.col("value")
    return u.select(
        "row_no", "column_name", "value",
        F.coalesce(S.is_number(v), F.lit(False)).alias("is_number"),
        F.coalesce(S.is_number(v, True), F.lit(False)).alias("is_float_text"),
        F.coalesce(S.has_digit(v), F.lit(False)).alias("has_digit"),
        S.text_length(v).alias("text_length"), S.integer_digits(v).alias("integer_digits"),
        S.fraction_digits(v).alias("fraction_digits"), S.day_key(S.parse_datetime(v)).alias("day_key"),
        S.base_name("file").alias("file_name"), S.extension("file").alias("file_ext"),
        S.mode_of_tab("tab").alias("mode"), S.is_schema_table("target_table").alias("table_ok"),
        F.split_part(F.col("target_table"), F.lit("."), F.lit(1)).alias("table_schema"),
        S.authors_text(F.array_compact(F.array(F.when(F.col("row_no") % 4 < 2, "Ann"),
                                               F.when(F.col("row_no") % 2 == 0, "Bob")))).alias("authors"))
