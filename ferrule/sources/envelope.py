"""Sheet envelope: parsed cells -> (table, header, rows) (A3, A15, A16, C16: cell A1 is the target table).

Parsed form, whatever the file format: ``path, tab, row_no, cells
array<string>`` (row 1 holds the table name in A1, row 2 the header, rows
3.. the data).  Everything here is a DataFrame operation; the envelope (one
row per tab) is joined back to the data rows on ``(path, tab)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

CELLS_SCHEMA = "path string, tab string, row_no bigint, cells array<string>"
CHUNK_BITS = 16         # 65,536 row numbers of a tab are a chunk


def normalize_cells(cells: Column | str) -> Column:
    """NULL tokens (pandas' default markers) become NULL; other text is kept."""
    c = F.col(cells) if isinstance(cells, str) else cells
    return F.transform(c, lambda x: F.when(~x.isin(*S.NULL_TOKENS), x))


def unique_names(cells: Column | str, width: Column | None = None) -> Column:
    """Header cells as names: blank -> ``Unnamed: <pos>``, repeats -> ``name.1``, ``name.2`` ...

    A name never repeats, also where a cell already reads ``name.1``.  ``width`` widens the
    header to the tab's widest row: columns without a header cell are named like blank ones."""
    c = F.col(cells) if isinstance(cells, str) else cells
    c = F.coalesce(c, F.expr("cast(array() as array<string>)"))
    if width is not None:
        c = F.concat(c, F.array_repeat(F.lit(None).cast("string"), F.greatest(width - F.size(c), F.lit(0))))
    base = F.transform(c, lambda x, i: F.when(x.isNull() | (F.trim(x) == ""), F.concat(F.lit("Unnamed: "), i.cast("string")))
                       .otherwise(F.trim(x)))

    def add(names: Column, name: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(1), F.size(names) + 1),
                                    lambda n: F.concat(name, F.lit("."), n.cast("string"))),
                        lambda x: ~F.array_contains(names, x))
        return F.concat(names, F.array(F.when(F.array_contains(names, name), free[0]).otherwise(name)))

    return F.aggregate(base, F.expr("cast(array() as array<string>)"), add)


def header_cells(parsed: DataFrame) -> DataFrame:
    """The cells of row 2 with their resolved names, one row per cell."""
    h = parsed.where(F.col("row_no") == 2).withColumn("names", unique_names("cells"))
    h = h.select("path", "tab", F.posexplode(F.arrays_zip(F.col("cells").alias("raw"), F.col("names").alias("name")))
                 .alias("position", "_c"))
    return h.select("path", "tab", F.col("position").cast("bigint").alias("position"),
                    F.col("_c.raw").alias("raw_name"), F.col("_c.name").alias("resolved_name"))


def _filled(cells: Column) -> Column:
    """The number of cells up to the last that holds text."""
    held = F.transform(cells, lambda x, i: F.when(x.isNotNull() & (F.trim(x) != ""), i + 1).otherwise(0))
    return F.coalesce(F.array_max(held), F.lit(0))


def envelopes(parsed: DataFrame) -> DataFrame:
    """One row per tab that has any row: target table, resolved header array, data row count.

    Nothing of a tab is left out: the header is as wide as the widest data row, a tab without
    a first row has no target table (C2 rejects it), one without data rows counts 0 (C4).
    Parsers may mark a tab without any row by one with row_no 0."""
    row, cells = F.col("row_no"), F.col("cells")
    # the two rows that name a tab are group keys: an aggregate that holds texts would sort all rows
    named = parsed.groupBy("path", "tab", F.when(row == 1, F.trim(F.get(cells, F.lit(0)))).alias("_t"), F.when(row == 2, cells).alias("_h")).agg(
        F.max(F.when(row > 2, _filled(cells)).otherwise(0)).alias("_width"), F.count(F.when(row > 2, 1)).alias("n_rows"))
    tabs = named.groupBy("path", "tab").agg(F.max("_t").alias("target_table"), F.min("_h").alias("_h"), F.max("_width").alias("_width"),
                                            F.sum("n_rows").alias("n_rows"))
    return tabs.select("path", "tab", "target_table", unique_names("_h", F.col("_width")).alias("header"), "n_rows")


def chunk() -> Column:
    """The chunk of its tab that a row belongs to, by its number."""
    return F.coalesce(F.shiftright(F.col("row_no").try_cast("bigint"), CHUNK_BITS), F.lit(0))


def by_chunk(rows: DataFrame, tabs: DataFrame) -> DataFrame:
    """``tabs`` with one row for each chunk that a tab has ``rows`` of: rows that are joined to it by ``path, tab, chunk``
    spread over the tasks, however many of them one tab holds."""
    return rows.select("path", "tab", "chunk").distinct().join(tabs, ["path", "tab"])


def split_rows(parsed: DataFrame, env: DataFrame | None = None) -> DataFrame:
    """A3: data rows (row_no > 2) with their tab's columns of ``env`` (one row per tab, or ``by_chunk``) and a header->cell map.

    Short rows are padded with NULL; a header is never narrower than its rows."""
    env = env if env is not None else envelopes(parsed)
    on = ["path", "tab", *(["chunk"] if "chunk" in env.columns else [])]
    rows = parsed.where(F.col("row_no") > 2).select("path", "tab", "row_no", "cells", chunk().alias("chunk"))
    width = F.size("header")
    padded = F.slice(F.concat(normalize_cells("cells"), F.array_repeat(F.lit(None).cast("string"), width)), 1, width)
    joined = rows.join(env, on).withColumn("row", F.map_from_arrays("header", padded))
    return joined.select("path", "tab", "target_table", "row_no", "row",
                         *[c for c in env.columns if c not in (*on, "target_table", "header", "n_rows")])
