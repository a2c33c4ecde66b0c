"""Workbook and CSV files -> parsed cells (A1-A4, A15 input side).

CSV files are read by splits, so one large file uses every core, also where quoted cells
run over several lines; a workbook is the unit of its own work.  Either way the result is ``(path, tab, row_no,
cells)`` rows and the rest is DataFrame work.  Only the standard library is
used inside tasks (zip + XML for .xlsx, the csv module for .csv).  Large
change sets may also arrive as Parquet with lineage columns (see
``plans.pipeline.run_batch``).
"""

from __future__ import annotations

import csv
import datetime as _dt
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fs

PARSED_SCHEMA = ("path string, tab string, tab_seq int, row_no bigint, cells array<string>, "
                 "authors array<string>")

csv.field_size_limit(sys.maxsize)      # a cell may be of any length, in every process that parses

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
       "dc": "http://purl.org/dc/elements/1.1/",
       "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"}
_REF = re.compile(r"([A-Z]+)([0-9]+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


# Built-in number formats that display a date or time (ECMA-376 numFmtId).
DATE_FORMAT_IDS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])
EXCEL_EPOCH = _dt.datetime(1899, 12, 30)


def _date_styles(zf: zipfile.ZipFile, names: set[str]) -> set[int]:
    """Indexes of cell styles (``s`` attribute) whose number format shows a date/time."""
    if "xl/styles.xml" not in names:
        return set()
    root = ET.fromstring(zf.read("xl/styles.xml"))
    custom = {}
    fmts = root.find("m:numFmts", _NS)
    if fmts is not None:
        for f in fmts.findall("m:numFmt", _NS):
            code = re.sub(r'"[^"]*"|\[[^]]*\]', "", f.get("formatCode", "")).lower()
            custom[int(f.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code))
    xfs = root.find("m:cellXfs", _NS)
    out = set()
    if xfs is not None:
        for i, xf in enumerate(xfs.findall("m:xf", _NS)):
            fid = int(xf.get("numFmtId", "0"))
            if fid in DATE_FORMAT_IDS or custom.get(fid, False):
                out.add(i)
    return out


def excel_serial_text(value: str) -> str:
    """An Excel date serial as ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss`` text (1900 system)."""
    days = float(value)
    ts = EXCEL_EPOCH + _dt.timedelta(days=days)
    ts = ts.replace(microsecond=0) + _dt.timedelta(seconds=round(ts.microsecond / 1e6))
    return ts.strftime("%Y-%m-%d") if days == int(days) else ts.strftime("%Y-%m-%d %H:%M:%S")


def xlsx_rows(data: bytes) -> tuple[list[str] | None, list[tuple[str, int, int, list[str | None]]]]:
    """(authors, [(tab, tab_seq, row_no, cells)]) of an .xlsx file; sparse cells placed by reference."""
    zf = zipfile.ZipFile(io.BytesIO(data))
    names = set(zf.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in root.findall("m:si", _NS)]
    authors = None
    if "docProps/core.xml" in names:
        creator = ET.fromstring(zf.read("docProps/core.xml")).find("dc:creator", _NS)
        if creator is not None and creator.text:
            authors = [a.strip() for a in re.split(r"[;,]", creator.text) if a.strip()]
    dates = _date_styles(zf, names)
    rels = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ET.fromstring(zf.read("xl/_rels/workbook.xml.rels")).findall("rel:Relationship", _NS):
            rels[r.get("Id")] = r.get("Target")
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    out = []
    for i, sheet in enumerate(wb.find("m:sheets", _NS).findall("m:sheet", _NS), start=1):
        target = rels.get(sheet.get(f"{{{_NS['r']}}}id"), f"worksheets/sheet{i}.xml")
        target = target.lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        ws = ET.fromstring(zf.read(part))
        for row in ws.iter(f"{{{_NS['m']}}}row"):
            row_no = int(row.get("r"))
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", _NS):
                m = _REF.match(c.get("r", ""))
                col = _col_index(m.group(1)) if m else len(cells)
                kind = c.get("t")
                v = c.find("m:v", _NS)
                if kind == "s" and v is not None:
                    val = shared[int(v.text)]
                elif kind == "inlineStr":
                    is_ = c.find("m:is", _NS)
                    val = _text(is_) if is_ is not None else None
                else:
                    val = v.text if v is not None else None
                    if val is not None and kind in (None, "n") and int(c.get("s", "0")) in dates:
                        val = excel_serial_text(val)      # a date cell: serial -> text
                cells[col] = val
            width = max(cells) + 1 if cells else 0
            out.append((sheet.get("name"), i, row_no, [cells.get(j) for j in range(width)]))
    return authors, out


def xlsx_tabs(data: bytes) -> list[str]:
    """Sheet names in order, also of sheets without rows."""
    wb = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("xl/workbook.xml"))
    return [s.get("name") for s in wb.find("m:sheets", _NS).findall("m:sheet", _NS)]


def csv_rows(data: bytes, tab: str) -> list[tuple[str, int, int, list[str | None]]]:
    text = data.decode("utf-8-sig")
    return [(tab, 1, i, [c if c != "" else None for c in rec])
            for i, rec in enumerate(csv.reader(io.StringIO(text)), start=1) if rec]


def csv_tab_name(path: str) -> str:
    """Tab of a CSV file: a ``tab=<name>`` folder if there is one, else the file stem; of one in parts, its folder's."""
    m = re.search(r"/tab=([^/]+)/[^/]*$", path) or re.search(r"/tab=([^/]+)\.(?:csv|txt)$", path, flags=re.I)
    if m:
        return unquote(m.group(1))
    return re.sub(r"\.(csv|txt)$", "", path.rsplit("/", 1)[-1], flags=re.I)


def csv_part(path: str) -> tuple[str, int] | None:
    """A CSV file may come in parts, as Spark writes it: the folder ``<name>.csv`` with files ``part-<n>...`` whose lines
    follow each other.  Of such a part, its folder and number; records don't run over parts' ends unless quoted."""
    m = re.search(r"^(.*\.(?:csv|txt))/part-(\d+)[^/]*\.(?:csv|txt)$", path, flags=re.I)
    return (m.group(1), int(m.group(2))) if m else None


def _stem(path: str) -> str:
    return unquote(path.rsplit("/", 1)[-1])


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole files -> cells, a file at a time; a file that can't be read becomes a tab without rows."""
    columns = ["path", "tab", "tab_seq", "row_no", "cells", "authors"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            low = path.lower()
            try:
                if low.endswith(TEXT_SUFFIXES):
                    authors, tabs, rows = None, [csv_tab_name(path)], csv_rows(bytes(content), csv_tab_name(path))
                elif low.endswith(SHEET_SUFFIXES):
                    authors, rows = xlsx_rows(bytes(content))
                    tabs = xlsx_tabs(bytes(content))
                else:
                    authors, tabs, rows = None, [_stem(path)], []
            except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, csv.Error):
                authors, tabs, rows = None, [_stem(path)], []
            rows = [(tab, seq, 0, None) for seq, tab in enumerate(tabs, start=1)] + rows      # a tab without rows is one too
            out = [(path, tab, seq, row_no, cells, authors) for tab, seq, row_no, cells in rows]
            for at in range(0, len(out), 10_000):
                yield pd.DataFrame(out[at:at + 10_000], columns=columns)


def parse_files(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows -> parsed cells (one file at a time in a task)."""
    return files.select("path", "content").mapInPandas(_parse_files, PARSED_SCHEMA)


TEXT_SUFFIXES, SHEET_SUFFIXES = (".csv", ".txt"), (".xlsx", ".xlsm")


def _literal(path: str) -> str:
    """A path in which no character is a wildcard."""
    return re.sub(r"([\[\]{}*?])", r"\\\1", path)


def _load(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load([_literal(p) for p in paths])


#: A cell after its comma: a quoted one with what follows its closing quote, or all up to the next comma.
CSV_CELL = r',("(?:[^"]++|"")*+"?[^,]*+|[^,]*+)'
#: Of a quoted cell: its text with doubled quotes, and what follows it.
CSV_QUOTED = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'


def _raw_cells(line: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_CELL), F.lit(1))


def csv_cells(line: Column) -> Column:
    """The cells of a line as the csv module reads it, empty ones as NULL: a quote opens a cell only at the cell's start,
    two inside it are one, and after the closing quote all is text up to the next comma."""
    def plain(cell: Column) -> Column:
        body, rest = F.regexp_extract(cell, CSV_QUOTED, 1), F.regexp_extract(cell, CSV_QUOTED, 2)
        return F.when(F.startswith(cell, F.lit('"')), F.concat(F.replace(body, F.lit('""'), F.lit('"')), rest)).otherwise(cell)

    cells = F.when(F.contains(line, F.lit('"')), F.transform(_raw_cells(line), plain)).otherwise(F.split(line, ",", -1))
    return F.transform(cells, lambda c: F.nullif(c, F.lit("")))


def _left_open(line: Column) -> Column:
    """Whether a line ends inside a quoted cell: its last cell's quote isn't closed."""
    return F.element_at(_raw_cells(line), -1).rlike(r'^"(?:[^"]++|"")*+$')


def read_csv_lines(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """CSV files by splits: any number of tasks per file, each row with its line number.

    Spark cuts the files into blocks; the lines of a block are numbered by their place in its task
    and moved on by the lines of the earlier blocks of the file and its parts (one row per block, which goes to every
    task: no line is shuffled).  Blank lines count but give no row.  Cells are cut out by expressions: no Python touches a line.  Files in which a quoted cell runs over
    several lines are for ``read_csv_records``."""
    lines = spark.read.text([_literal(p) for p in paths]).select(
        "value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("uri", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("file", _one_spelling("uri")).join(files.select(F.col("uri").alias("file"), "path", "tab", "part"), "file")
    earlier = Window.partitionBy("path").orderBy("part", "uri", "block").rowsBetween(Window.unboundedPreceding, -1)
    skip = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1
    blocks = blocks.select("uri", "block", "path", "tab", skip.alias("skip"))
    row_no = F.col("at") + F.col("skip")
    numbered = lines.join(F.broadcast(blocks), ["uri", "block"]).select(
        "path", "tab", row_no.alias("row_no"),
        F.when(row_no == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))
    return numbered.where(F.col("value") != "").select(
        "path", "tab", F.lit(1).alias("tab_seq"), "row_no", csv_cells(F.col("value")).alias("cells"),
        F.lit(None).cast("array<string>").alias("authors"))


def _one_spelling(uri: str):
    """Local paths come as ``file:/`` or ``file:///``."""
    return F.regexp_replace(uri, "^file:/+", "file:///")


def _inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, as the csv module reads it: a quote opens a cell
    only at the cell's start, and after the closing quote all is text up to the next comma."""
    at = 0
    while True:
        if not inside:
            q = line.find('"', at)
            if q < 0:
                return False
            if q > at and line[q - 1] != ",":        # a stray quote: text
                at = line.find(",", q) + 1
                if not at:
                    return False
                continue
            at = q + 1
        q = line.find('"', at)
        if q < 0:
            return True
        inside = line.startswith('"', q + 1)
        at = q + 2 if inside else line.find(",", q) + 1
        if not at:
            return False


def _broken_quotes(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files in which a quoted cell goes on in the next line."""
    quoted = spark.read.text([_literal(p) for p in paths]).where(F.contains("value", F.lit('"')))
    quoted = quoted.select(F.regexp_replace("value", "^\ufeff", "").alias("value"), _one_spelling("_metadata.file_path").alias("uri"))
    return {r[0] for r in quoted.where(_left_open(F.col("value"))).select("uri").distinct().collect()}      # file names


def _line_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines (cut at \\n, \\r or both, the end kept) with what they are if their block starts outside (0) or inside (1) a
    quoted cell: whether they start and end inside one, and how many records have begun in the block."""
    block = None
    for pdf in batches:
        out = []
        for value, uri, start in zip(pdf["value"], pdf["uri"], pdf["block"], strict=True):
            first = (uri, start) != block
            if first:
                block, state, n = (uri, start), [False, True], [0, 0]
            if first and start == 0:
                value = value.removeprefix("\ufeff")
            lines = re.findall(r"[^\r]*\r|[^\r]+$", value) or [""]
            lines[-1] += "\n"
            for line in lines:
                text = line.rstrip("\r\n")
                before, begun = list(state), [c + (not b) for c, b in zip(n, state, strict=True)]
                state, n = [_inside(text, b) for b in before] if before[0] != before[1] else [_inside(text, before[0])] * 2, begun
                out.append((uri, start, line, *before, *state, *n))
        yield pd.DataFrame(out, columns=["uri", "block", "line", "in0", "in1", "end0", "end1", "n0", "n1"])


def _block_starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of one file's blocks (one row each): whether each starts inside a quoted cell, and the records before it."""
    out, inside, n = [], False, 0
    for r in blocks.sort_values(["part", "uri", "block"]).itertuples():
        out.append((r.uri, r.block, r.path, r.part, inside, n))
        inside, n = bool(r.end1 if inside else r.end0), n + int(r.n1 if inside else r.n0)
    return pd.DataFrame(out, columns=["uri", "block", "path", "part", "inside", "before"])


def _parse_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(path, csv_tab_name(path), 1, int(n), [c if c != "" else None for c in cells], None)
                for path, n, lines in zip(pdf["path"], pdf["row_no"], pdf["lines"], strict=True)
                if (cells := next(csv.reader(iter(lines)), []))]
        yield pd.DataFrame(rows, columns=["path", "tab", "tab_seq", "row_no", "cells", "authors"])


def read_csv_records(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """CSV files with line breaks inside cells, by splits too, each row with its record number.

    Whether a line starts inside a quoted cell follows from its block's lines before it and from how the block
    starts; that follows from the blocks before it (one row per block). Only the lines of a
    record of several lines are brought together. Blank records count but give no row."""
    text = spark.read.option("lineSep", "\n").text([_literal(p) for p in paths]).select(
        "value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"))
    lines = text.mapInPandas(_line_states, "uri string, block bigint, line string, in0 boolean, in1 boolean, end0 boolean, "
                                           "end1 boolean, n0 bigint, n1 bigint").withColumn("at", F.monotonically_increasing_id())
    last = F.max_by(F.struct("end0", "end1", "n0", "n1"), "at").alias("l")
    blocks = lines.groupBy("uri", "block").agg(last).select("uri", "block", "l.*", _one_spelling("uri").alias("file"))
    blocks = blocks.join(files.select(F.col("uri").alias("file"), "path", "part"), "file").groupBy("path").applyInPandas(
        _block_starts, "uri string, block bigint, path string, part int, inside boolean, before bigint")
    of = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = lines.join(blocks, ["uri", "block"]).select(
        "path", (F.col("before") + of("n")).alias("row_no"), (of("in") | of("end")).alias("cut"), "part", "uri", "block", "at", "line")
    whole = placed.where("not cut").select("path", "row_no", F.array("line").alias("lines"))
    parts = placed.where("cut").groupBy("path", "row_no").agg(
        F.sort_array(F.collect_list(F.struct("part", "uri", "block", "at", "line"))).alias("l"))
    return whole.unionByName(parts.select("path", "row_no", F.col("l.line").alias("lines"))).mapInPandas(_parse_records, PARSED_SCHEMA)


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A1+A2: every tab of the files as parsed cells, with the files' modification times.

    CSV is read by splits, one in parts as one file; workbooks one file at a time.  Every file gives at least a row with row_no 0, so that an empty one is a tab too; other
    kinds of files and unreadable ones are a tab without rows."""
    if not paths:
        return spark.createDataFrame([], PARSED_SCHEMA + ", modificationTime timestamp")
    names = [{"path": p, "uri": re.sub("^file:/+", "file:///", u), "ms": ms} for p, u, ms in fs.files(spark, *paths)]
    for r in names:
        r["file"], r["part"] = csv_part(r["path"]) or (r["path"], 0)
    files = spark.createDataFrame([(r["file"], r["uri"], csv_tab_name(r["file"]), r["part"]) for r in names],
                                  "path string, uri string, tab string, part int")    # metadata: one row per file or part
    times: dict[str, int] = {}
    for r in names:
        times[r["file"]] = max(r["ms"], times.get(r["file"], r["ms"]))
    changed = spark.createDataFrame(list(times.items()), "path string, ms bigint").select(
        "path", F.timestamp_millis("ms").alias("modificationTime"))
    texts = [r for r in names if r["path"].lower().endswith(TEXT_SUFFIXES)]
    text = [r["path"] for r in texts]
    broken = _broken_quotes(spark, text) if text else set()
    whole = {r["file"] for r in texts if r["uri"] in broken}      # with all its parts
    by_split = [r["path"] for r in texts if r["file"] not in whole]
    by_record = [r["path"] for r in texts if r["file"] in whole]
    by_file = sorted({r["path"] for r in names} - set(text))
    frames = []
    if text:
        frames.append(spark.createDataFrame([(p, csv_tab_name(p), 1, 0, None, None) for p in sorted({r["file"] for r in texts})], PARSED_SCHEMA))
    if by_split:
        frames.append(read_csv_lines(spark, files, by_split))
    if by_record:
        frames.append(read_csv_records(spark, files, by_record))
    if by_file:
        frames.append(parse_files(_load(spark, by_file)))
    return reduce(DataFrame.unionByName, frames).join(F.broadcast(changed), "path")      # one row per file, as listed here


def inbox_files(spark: SparkSession, inbox: str) -> list[str]:
    """A1: paths of all files in the inbox, whatever their kind (metadata)."""
    return [path for path, _, _ in fs.files(spark, inbox)]


def read_inbox(spark: SparkSession, inbox: str) -> DataFrame:
    """Every file of a folder, see ``read_paths``."""
    return read_paths(spark, inbox_files(spark, inbox))
