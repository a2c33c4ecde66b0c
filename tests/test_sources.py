"""Workbook parsing, copy-on-write tables, the change run and the inbox stream."""

import io
import zipfile

from pyspark.sql import functions as F

from ferrule.operators.tables import TableStore, part_key
from ferrule.plans import fixtures as X
from ferrule.plans.pipeline import RunConfig, run
from ferrule.sources import envelope as EV
from ferrule.sources.workbook import parse_files, xlsx_rows

from .conftest import SF_SMALL


def make_xlsx(sheets, creator="Ann; Bob"):
    """Minimal .xlsx: sheets = {name: [[cell, ...], ...]}; strings shared, numbers as values, sparse."""
    shared, sheet_xml = [], []
    for rows in sheets.values():
        out = []
        for r, row in enumerate(rows, start=1):
            cells = []
            for c, v in enumerate(row):
                if v is None:
                    continue
                ref = f"{chr(65 + c)}{r}"
                if isinstance(v, (int, float)):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                else:
                    shared.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            out.append(f'<row r="{r}">{"".join(cells)}</row>')
        sheet_xml.append('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
                         + "".join(out) + "</sheetData></worksheet>")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" ' \
         'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    wb = f"<workbook {ns}><sheets>" + "".join(
        f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, start=1)) + "</sheets></workbook>"
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
        f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" '
        f'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/>'
        for i in range(1, len(sheets) + 1)) + "</Relationships>"
    sst = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(
        f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    core = ('<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" '
            f'xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{creator}</dc:creator></cp:coreProperties>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("docProps/core.xml", core)
        for i, x in enumerate(sheet_xml, start=1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", x)
    return buf.getvalue()


def test_xlsx_rows_sparse_and_author():
    data = make_xlsx({"Update_a": [["pub.orders"], ["o_orderkey", "o_orderstatus"], [1, "F"], [2, None], [None, "O"]]})
    authors, rows = xlsx_rows(data)
    assert authors == ["Ann", "Bob"]
    assert rows[0] == ("Update_a", 1, 1, ["pub.orders"])
    assert rows[3] == ("Update_a", 1, 4, ["2"])
    assert rows[4] == ("Update_a", 1, 5, [None, "O"])


def test_workbook_files_to_rows(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(make_xlsx({
        "Update_x": [["pub.orders"], ["o_orderkey", "o_orderstatus", "o_orderstatus", ""], [1, "F", "NA", "z"]],
        "notes": [["pub.orders"], ["a"]]}))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    parsed = parse_files(files)
    rows = EV.split_rows(parsed).collect()
    assert len(rows) == 1
    assert rows[0].row == {"o_orderkey": "1", "o_orderstatus": "F", "o_orderstatus.1": None, "Unnamed: 3": "z"}
    env = {r.tab: r for r in EV.envelopes(parsed).collect()}
    assert env["notes"].n_rows == 0 and env["Update_x"].target_table == "pub.orders"


def test_table_store_rewrites_only_touched_partitions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.range(0, 100).select("id", (F.col("id") % 4).alias("p"), F.lit("x").alias("s"))
    store.create("s.t", df, partition_by="p")
    batch = spark.createDataFrame([(1, "y"), (5, "y")], "id long, s string")     # both in p = 1
    store.update("s.t", batch, "id")
    part = {p: spark.range(1).select(part_key(F.lit(p))).first()[0] for p in range(4)}
    m = {r.part: r.path for r in store.manifest("s.t").collect()}
    assert "/v000002-" in m[part[1]] and "/v000001-" in m[part[0]] and len(m) == 4
    got = store.read("s.t")
    assert got.count() == 100 and got.where(F.col("s") == "y").count() == 2
    store.insert("s.t", spark.createDataFrame([(1000, 3, "n")], "id long, p long, s string"))
    assert store.read("s.t").count() == 101
    paths = [r.path for r in store.manifest("s.t").collect()]
    assert len(paths) == 5 and sum("/v000003-" in p for p in paths) == 1            # an insert only adds


def _store(spark, root):
    store = TableStore(spark, root)
    store.create("pub.orders", X.target_orders(spark, SF_SMALL), partition_by="o_orderpriority")
    store.create("pub.customer", X.table(spark, SF_SMALL, "customer"), partition_by="c_mktsegment")
    return store


def _cfg(root, run_id="r1"):
    return RunConfig(run_id, X.AS_OF, f"{root}/locker", f"{root}/quarantine", f"{root}/errors", f"{root}/events")


def test_change_run_end_to_end(spark, tmp_path):
    from ferrule.plans.pipeline import _with_file_order
    from ferrule.plans.queries_io import write_csv_tabs
    from ferrule.sources.workbook import read_inbox

    inbox = str(tmp_path / "inbox")
    write_csv_tabs(X.update_orders(spark, SF_SMALL), list(X.UPDATE_ORDERS_HEADER), inbox)
    store = _store(spark, str(tmp_path / "tables"))
    catalog = X.declared_catalog(spark, SF_SMALL)
    cfg = _cfg(str(tmp_path / "out"))
    parsed = _with_file_order(read_inbox(spark, inbox))
    events = run(spark, parsed, catalog, store, cfg).collect()
    assert len(events) == 1
    # the table now equals the registered update query (which stamps edit_dt the same way)
    from ferrule.plans.queries import update_apply

    expected = update_apply(spark, SF_SMALL)
    got = store.read("pub.orders").select(*expected.columns)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    q = spark.read.parquet(cfg.quarantine_path)
    n_q = q.count()
    locker = spark.read.parquet(cfg.locker_path)
    n_l = locker.count()
    assert n_q > 0 and n_l > 0
    # the same run again, on the same store: nothing doubles, nothing changes
    images = sorted(str(sorted(r.row.items())) for r in locker.collect())
    v = store.version("pub.orders")
    again = run(spark, _with_file_order(read_inbox(spark, inbox)), catalog, store, cfg).collect()
    assert sorted(map(str, again)) == sorted(map(str, events)) and store.version("pub.orders") == v
    assert spark.read.parquet(cfg.quarantine_path).count() == n_q
    assert sorted(str(sorted(r.row.items())) for r in spark.read.parquet(cfg.locker_path).collect()) == images
    assert len(images) == n_l
    # after a crash between preserving and committing, the retry starts from the same table
    store2 = _store(spark, str(tmp_path / "tables2"))
    run(spark, _with_file_order(read_inbox(spark, inbox)), catalog, store2, cfg)
    assert spark.read.parquet(cfg.quarantine_path).count() == n_q
    assert sorted(str(sorted(r.row.items())) for r in spark.read.parquet(cfg.locker_path).collect()) == images


def test_stream_processes_each_file_once(spark, tmp_path):
    from ferrule.plans.queries_io import write_csv_tabs
    from ferrule.streaming.inbox import run_stream

    inbox = str(tmp_path / "inbox")
    write_csv_tabs(X.update_dups(spark, SF_SMALL), list(X.UPDATE_DUPS_HEADER), inbox)
    store = _store(spark, str(tmp_path / "tables"))
    catalog = X.declared_catalog(spark, SF_SMALL)
    seen = []

    def handle(parsed, batch_id):
        seen.append(batch_id)
        run(spark, parsed, catalog, store, _cfg(str(tmp_path / "out"), f"s-{batch_id}"))

    ckpt = str(tmp_path / "ckpt")
    run_stream(spark, inbox, ckpt, handle)
    n = len(seen)
    v = store.version("pub.orders")
    run_stream(spark, inbox, ckpt, handle)          # same checkpoint: nothing new
    assert len(seen) == n and store.version("pub.orders") == v


def test_written_locker_retention_removes_whole_partitions(spark, tmp_path):
    from ferrule.operators import locker as L

    path = str(tmp_path / "locker")
    lk = X.locker(spark, SF_SMALL)
    lk.write.partitionBy("day", "target_table").parquet(path)
    keep = L.purge(lk, None, X.AS_OF).count()
    removed = L.purge_written(spark, path, None, X.AS_OF)
    assert removed
    assert spark.read.parquet(path).count() == keep


def test_wave_chains_before_images_across_tabs(spark, tmp_path):
    """Two tabs of one wave change key 1: the table ends with the later value and each
    tab's before image is the value the previous tab left."""
    cells = [("f.csv", "update_a", 1, 1, ["pub.orders"]), ("f.csv", "update_a", 1, 2, ["o_orderkey", "o_orderstatus"]),
             ("f.csv", "update_a", 1, 3, ["1", "A"]),
             ("f.csv", "update_b", 2, 1, ["pub.orders"]), ("f.csv", "update_b", 2, 2, ["o_orderkey", "o_orderstatus"]),
             ("f.csv", "update_b", 2, 3, ["1", "B"]), ("f.csv", "update_b", 2, 4, ["2", "C"])]
    parsed = spark.createDataFrame([(p, t, s, r, c, None, 1) for p, t, s, r, c in cells],
                                   "path string, tab string, tab_seq int, row_no bigint, cells array<string>, "
                                   "authors string, file_seq bigint")
    store = _store(spark, str(tmp_path / "tables"))
    before = {r.o_orderkey: r.o_orderstatus for r in store.read("pub.orders").where("o_orderkey in (1, 2)").collect()}
    cfg = _cfg(str(tmp_path / "out"), "w1")
    run(spark, parsed, X.declared_catalog(spark, SF_SMALL), store, cfg)
    after = {r.o_orderkey: r.o_orderstatus for r in store.read("pub.orders").where("o_orderkey in (1, 2)").collect()}
    assert after == {1: "B", 2: "C"}
    lk = {(r.item_id, r.row["o_orderkey"]): r.row["o_orderstatus"] for r in spark.read.parquet(cfg.locker_path).collect()}
    assert lk == {("w1:f.csv#update_a", "1"): before[1], ("w1:f.csv#update_b", "1"): "A",
                  ("w1:f.csv#update_b", "2"): before[2]}


def test_xlsx_date_cells_become_date_text():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/'
                                      f'2006/relationships"><sheets><sheet name="Insert_x" sheetId="1" r:id="rId1"/>'
                                      f'</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="164" '
                                    f'formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs count="3">'
                                    f'<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet {ns}><sheetData><row r="3"><c r="A3" s="1"><v>45292</v></c>'
                   f'<c r="B3" s="2"><v>45292.5</v></c><c r="C3"><v>45292</v></c></row></sheetData></worksheet>')
    _, rows = xlsx_rows(buf.getvalue())
    assert rows == [("Insert_x", 1, 3, ["2024-01-01", "2024-01-01 12:00:00", "45292"])]


def test_xml_flatten_attributes_text_and_repeats(spark, tmp_path):
    from ferrule.sources import xmlio as XM

    (tmp_path / "a.xml").write_text(
        '<items><item id="1" kind="x"><name> a </name><sub k="2">t</sub><tag>p</tag><tag>q</tag></item>'
        '<item id="2"><name>b</name><sub k="3">u</sub><tag>r</tag></item></items>')
    flat = XM.flatten(XM.read_records(spark, str(tmp_path), "item"))
    got = sorted((r.asDict() for r in flat.collect()), key=lambda d: d["id"])
    assert got[0] == {"id": "1", "kind": "x", "name": "a", "k": "2", "sub": "t", "tag": "p"}
    assert got[1]["kind"] is None and got[1]["tag"] == "r"
    recs = XM.read_records(spark, str(tmp_path), "item")
    pos = F.struct(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"))
    merged = {r.key: r.value for r in XM.merge_first(XM.flatten(recs.withColumn("_pos", pos), keep=["_pos"]),
                                                     "_pos").collect()}
    assert merged == {"id": "1", "kind": "x", "name": "a", "k": "2", "sub": "t", "tag": "p"}


def test_xml_writer_skips_empty_cells_and_escapes(spark, tmp_path):
    from ferrule.sources import xmlio as XM

    df = spark.createDataFrame([("1", "a<b", None), ("2", "", "z")], "k string, v string, w string")
    XM.write_records(df, str(tmp_path / "x"))
    back = sorted((r.var_name, r.value) for r in XM.read_var_records(spark, str(tmp_path / "x")).collect())
    assert back == [("k", "1"), ("k", "2"), ("v", "a<b"), ("w", "z")]
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("*.xml"))
    assert "a&lt;b" in text and 'var_name="w"' in text


def test_table_store_old_readers_keep_their_snapshot(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.create("s.t", spark.range(0, 20).select("id", (F.col("id") % 2).alias("p"), F.lit("x").alias("s")),
                 partition_by="p")
    old = store.read("s.t")
    store.update("s.t", spark.createDataFrame([(4, "y")], "id long, s string"), "id")
    assert old.where(F.col("s") == "y").count() == 0                 # the old version is untouched
    assert store.read("s.t").where(F.col("s") == "y").count() == 1
    assert store.version("s.t") == 2


def test_store_versions_are_strict_and_published_once(spark, tmp_path):
    import pytest

    from ferrule import fs

    store = TableStore(spark, str(tmp_path))
    assert store.version("s.t") == 0
    with pytest.raises(ValueError):
        store.read("s.t")
    df = spark.createDataFrame([(1, "007"), (2, None), (3, "a b/c")], "id long, p string")
    store.create("s.t", df, partition_by="p")
    assert sorted((r.id, r.p) for r in store.read("s.t").collect()) == [(1, "007"), (2, None), (3, "a b/c")]
    with pytest.raises(Exception, match="exist"):
        fs.create_text(spark, f"{tmp_path}/s.t/_commits/v000001", "again")
    store.insert("s.t", df.limit(0), "token")
    assert store.applied("s.t", "token") and not store.applied("s.t", "other")
    assert store.read("s.t").count() == 3 and store.version("s.t") == 2


def test_csv_by_splits_numbers_lines_and_loses_nothing(spark, tmp_path):
    from ferrule.sources.workbook import read_inbox

    lines = ["pub.orders", "o_orderkey,o_orderstatus"] + [f'{i},"a,{i}"' if i % 3 else f"{i}," for i in range(3, 4000)]
    (tmp_path / "Update_big.csv").write_text("\ufeff" + "\n".join(lines))
    (tmp_path / "UPDATE_UPPER.CSV").write_text("pub.orders\n\nx,y\n")
    (tmp_path / "update_quoted.csv").write_text('pub.orders\nk,v\n1,"two\nlines"\n')
    (tmp_path / "update_[x] y.csv").write_text("")
    (tmp_path / "~$a.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_inbox(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    tabs = {}
    for r in rows:
        tabs.setdefault(r.tab, {})[r.row_no] = r.cells
    big = tabs["Update_big"]
    assert sorted(big) == list(range(len(lines) + 1)) and big[1] == ["pub.orders"]
    assert all(big[i] == [str(i), f"a,{i}" if i % 3 else None] for i in range(3, 4000))
    assert tabs["UPDATE_UPPER"] == {0: None, 1: ["pub.orders"], 3: ["x", "y"]}
    assert tabs["update_quoted"][3] == ["1", "two\nlines"]
    assert tabs["update_[x] y"] == {0: None} and tabs["~$a.xlsx"] == {0: None} and tabs["old.xls"] == {0: None}


def test_csv_with_breaks_in_cells_and_long_cells_is_read_by_splits(spark, tmp_path, monkeypatch):
    import csv

    import pytest

    from ferrule.sources import workbook

    long = "x" * 200_000                       # above the csv module's default limit
    lines = ["pub.orders", "k,v"] + [[f'{i},"two\nlines, ""{i}"""', f'{i},5" pipe', f"{i},plain", "", f'{i},"\n\n",z', f'{i},a"b,"open\nshut"'][i % 6]
                                     for i in range(2000)]
    files = {"update_breaks.csv": "\n".join(lines) + "\n", "update_crlf.csv": "\ufeff" + "\r\n".join(["pub.orders", '"k\r\nk",v', "1,2"]),
             "update_long.csv": f'pub.orders\nk,v\n1,{long}\n2,"{long}\n"\n3,c\n', "update_wide.csv": f"pub.orders\nk,v\n1,{long}\n2,b\n",
             "update_stray.csv": 'pub.orders\nk,v\n1,5" pipe\n2,b\n', "update_open.csv": 'pub.orders\nk,v\n1,"never\nclosed,x\n'}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content.encode())
    monkeypatch.setattr(workbook, "_load", lambda *a: pytest.fail("a CSV file is read whole"))
    assert workbook._broken_quotes(spark, [str(tmp_path / "update_stray.csv")]) == set()
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = workbook.read_inbox(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    for name, content in files.items():
        want = {n: [c or None for c in cells] for n, cells in enumerate(csv.reader(io.StringIO(content.removeprefix("\ufeff"), newline="")), start=1) if cells}
        got = [(r.row_no, r.cells) for r in rows if r.tab == name[:-4]]
        assert len(got) == len(want) + 1 and dict(got) == {0: None, **want}, name


def test_envelopes_keep_wide_rows_missing_heads_and_empty_tabs(spark):
    rows = [("f", "update_a", 1, ["pub.t"]), ("f", "update_a", 2, ["a", "a", "a.1"]), ("f", "update_a", 3, ["1", "2", "3", None, "5"]),
            ("f", "update_a", 4, ["1", "2", "3", None, None, " "]), ("f", "update_b", 2, ["k"]), ("f", "update_b", 3, ["1"]), ("f", "update_c", 0, None)]
    parsed = spark.createDataFrame(rows, "path string, tab string, row_no bigint, cells array<string>")
    env = {r.tab: r for r in EV.envelopes(parsed).collect()}
    assert env["update_a"].header == ["a", "a.1", "a.1.1", "Unnamed: 3", "Unnamed: 4"]
    assert env["update_b"].target_table is None and env["update_b"].n_rows == 1
    assert env["update_c"].n_rows == 0 and env["update_c"].header == []
    got = {(r.tab, r.row_no): r.row for r in EV.split_rows(parsed).collect()}
    assert got["update_a", 3] == {"a": "1", "a.1": "2", "a.1.1": "3", "Unnamed: 3": None, "Unnamed: 4": "5"}
    assert set(got) == {("update_a", 3), ("update_a", 4), ("update_b", 3)}


def test_inbox_files_are_archived_after_the_run(spark, tmp_path):
    from ferrule.plans.pipeline import run_inbox

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "update_x.csv").write_text("pub.orders\no_orderkey,o_orderstatus\n1,F\n")
    (inbox / "old.xls").write_bytes(b"x")
    store = _store(spark, str(tmp_path / "tables"))
    events = run_inbox(spark, str(inbox), X.declared_catalog(spark, SF_SMALL), store, _cfg(str(tmp_path / "out"), "arch"),
                       archive=str(tmp_path / "done"))
    assert sorted(r.level for r in events.collect()) == ["info", "warning"]
    assert sorted(p.name for p in (tmp_path / "done" / "arch").iterdir() if not p.name.startswith(".")) == ["old.xls", "update_x.csv"]
    assert not [p for p in inbox.iterdir() if not p.name.startswith(".")]


def test_declared_types_reach_the_spec(spark):
    from ferrule.operators.catalog import spec_from_schema

    spark.sql("CREATE TABLE IF NOT EXISTS declared_t (a VARCHAR(5) NOT NULL, b CHAR(3), c TINYINT, d BINARY, e STRING) USING parquet")
    try:
        schema = spark.table("declared_t").schema
    finally:
        spark.sql("DROP TABLE declared_t")
    got = {c.name: (c.data_type, c.char_max_len) for c in spec_from_schema("x.t", schema).columns}
    assert got == {"a": ("varchar", 5), "b": ("char", 3), "c": ("tinyint", None), "d": ("varbinary", -1), "e": ("nvarchar", -1)}


def test_a_run_starts_with_retention(spark, tmp_path):
    from ferrule.operators import locker as L
    from ferrule.operators import quarantine as Q

    cfg = _cfg(str(tmp_path / "out"), "keep")
    old = spark.range(2).select(
        F.when(F.col("id") == 0, "19970101").otherwise("19971231").alias("day"), F.lit("pub.a b").alias("target_table"),
        F.lit("r0").alias("run_id"), F.lit("i").alias("item_id"), F.lit("f").alias("file"), F.lit(None).cast("string").alias("authors"),
        F.lit("Update").alias("mode"), F.lit(X.AS_OF).cast("timestamp_ntz").alias("append_time"), F.col("id").alias("row_no"),
        Q.row_map(["id"]).alias("row"))
    L.append(old, cfg.locker_path)
    cells = [("f.csv", "update_a", 1, 1, ["pub.orders"]), ("f.csv", "update_a", 1, 2, ["o_orderkey", "o_orderstatus"]),
             ("f.csv", "update_a", 1, 3, ["1", "A"])]
    parsed = spark.createDataFrame([(p, t, s, r, c, None, 1) for p, t, s, r, c in cells],
                                   "path string, tab string, tab_seq int, row_no bigint, cells array<string>, "
                                   "authors string, file_seq bigint")
    run(spark, parsed, X.declared_catalog(spark, SF_SMALL), _store(spark, str(tmp_path / "tables")), cfg)
    days = {(r.day, r.target_table) for r in L.read(spark, cfg.locker_path).collect()}
    assert days == {("19971231", "pub.a b"), ("19980101", "pub.orders")}


def test_the_stream_archives_what_it_has_read(spark, tmp_path):
    """A file moves to the archive once a later batch runs; none is read twice, none is lost."""
    from ferrule.streaming.inbox import run_stream

    inbox, archive, ckpt, seen = tmp_path / "inbox", tmp_path / "archive", str(tmp_path / "ckpt"), []
    inbox.mkdir()

    def handle(parsed, batch_id):
        seen.extend(sorted({r.path.rsplit("/", 1)[-1] for r in parsed.select("path").collect()}))

    for i in range(4):
        (inbox / f"update_{i}.csv").write_text(f"pub.orders\no_orderkey,o_orderstatus\n{i},A\n")
        run_stream(spark, str(inbox), ckpt, handle, archive_dir=str(archive))
    names = {f"update_{i}.csv" for i in range(4)}
    assert seen == sorted(names)
    moved = {p.name for p in archive.rglob("*.csv")}
    left = {p.name for p in inbox.glob("*.csv")}
    assert moved | left == names and not moved & left and len(moved) >= 2 and "update_3.csv" in left


def test_csv_cells_are_those_of_the_csv_module(spark):
    import csv
    import random

    from ferrule.sources.workbook import _inside, _left_open, csv_cells

    rnd = random.Random(4)
    lines = ["".join(rnd.choice(['"', '""', ",", "a", " ", "é", "'", "\\", "x y", " "]) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    lines += [",", ",,", '""', '"a""b",c', 'a"b,"c"d",e', '"x"y"z,w', "a,b,", ' "a",b', '"' + "q" * 50_000 + '",1', "w," * 20_000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    rows = {r.i: r for r in df.select("i", csv_cells(df.value).alias("cells"), _left_open(df.value).alias("open")).collect()}
    for i, line in enumerate(lines):
        assert rows[i].open == _inside(line, False), line
        if not rows[i].open:
            assert rows[i].cells == [c if c != "" else None for c in next(csv.reader([line]))], line


def test_no_python_reads_a_plain_csv_file(spark, tmp_path):
    from ferrule.sources.workbook import read_paths

    path = tmp_path / "update_a.csv"
    path.write_text('pub.orders\no_orderkey,o_orderstatus\n1,"A, ""B"""\n\n2,\n')
    df = read_paths(spark, [str(path)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got = sorted((r.row_no, r.cells) for r in df.collect() if r.row_no)
    assert got == [(1, ["pub.orders"]), (2, ["o_orderkey", "o_orderstatus"]), (3, ["1", 'A, "B"']), (5, ["2", None])]


def test_a_csv_file_in_parts_is_one_tab(spark, tmp_path):
    """Parts are read in their order as one file: line numbers and quoted cells run on, parts past 99999 come last."""
    from ferrule.plans.queries_io import write_csv_tabs
    from ferrule.sources.workbook import read_inbox

    for name, cell in (("plain", "x"), ("quoted", '"x\ny"')):
        folder = tmp_path / "in" / f"tab=update_{name}.csv"
        folder.mkdir(parents=True)
        (folder / "part-99999-a.txt").write_text(f"pub.orders\nk,v\n1,{cell}\n")
        (folder / "part-100000-a.txt").write_text(f"2,{cell}\n\n3,{cell}\n")
    got = {}
    for r in read_inbox(spark, str(tmp_path / "in")).where("row_no > 0").collect():
        got.setdefault((r.path.rsplit("/", 1)[-1], r.tab), {})[r.row_no] = r.cells
    for name, cell in (("plain", "x"), ("quoted", "x\ny")):
        assert got.pop((f"tab=update_{name}.csv", f"update_{name}")) == {
            1: ["pub.orders"], 2: ["k", "v"], 3: ["1", cell], 4: ["2", cell], 6: ["3", cell]}
    assert not got
    # the fixture's writer spreads a tab over tasks
    batch = spark.range(20_000).selectExpr("'Update a' AS tab", "'pub.orders' AS target_table", "id * 3 AS row_no", "concat('v', id) AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_csv_tabs(batch, ["v"], str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "out" / "tab=Update a.csv").glob("part-*.txt"))) > 4
    rows = EV.split_rows(read_inbox(spark, str(tmp_path / "out"))).select("tab", "row_no", F.col("row")["v"].alias("v")).collect()
    assert sorted((r.tab, r.row_no, r.v) for r in rows) == [("Update a", i + 3, f"v{i}") for i in range(20_000)]


def test_half_a_csv_file_in_parts_is_an_error_of_the_stream(spark, tmp_path):
    import pytest

    from ferrule.streaming.inbox import run_stream

    folder = tmp_path / "in" / "update_x.csv"
    folder.mkdir(parents=True)
    (folder / "part-00000.csv").write_text("pub.orders\no_orderkey\n1\n")
    (folder / "part-00001.csv").write_text("2\n")
    seen = []
    with pytest.raises(Exception, match="move folders in whole"):
        run_stream(spark, str(tmp_path / "in"), str(tmp_path / "c1"), lambda df, b: seen.append(df.count()), max_files_per_batch=1)
    assert not seen
    run_stream(spark, str(tmp_path / "in"), str(tmp_path / "c2"), lambda df, b: seen.append(df.where("row_no > 0").count()))
    assert seen == [4]


def test_envelopes_sort_no_rows(spark):
    parsed = spark.range(100).selectExpr("'p' AS path", "'t' AS tab", "id AS row_no", "array(string(id), 'a') AS cells")
    plan = EV.envelopes(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(") == 2 and plan.count("Sort [") <= 2      # all rows are hashed, only tabs are sorted
    assert EV.envelopes(parsed).collect()[0].header == ["2", "a"]


def _parsed(spark, rows):
    return spark.createDataFrame([(p, t, s, r, c, None, 1) for p, t, s, r, c in rows],
                                 "path string, tab string, tab_seq int, row_no bigint, cells array<string>, authors string, file_seq bigint")


def test_no_task_judges_a_whole_tab(spark, tmp_path, monkeypatch):
    """A tab's rows are dealt out by chunks also where its facts are too large to go to every task."""
    from ferrule.plans import pipeline

    monkeypatch.setattr(EV, "CHUNK_BITS", 4)
    tasks, written = [], pipeline._written
    monkeypatch.setattr(pipeline, "_written", lambda judged: tasks.append(
        judged.withColumn("task", F.spark_partition_id()).groupBy("tab").agg(
            F.countDistinct("task").alias("tasks"), F.count("*").alias("n")).first()) or written(judged))
    rows = [("f.csv", "update_a", 1, 1, ["pub.orders"]), ("f.csv", "update_a", 1, 2, ["o_orderkey", "o_orderstatus"]),
            *(("f.csv", "update_a", 1, i + 3, [str(i), "A" if i % 3 else "too long"]) for i in range(600)),
            ("g.csv", "nothing", 1, 1, ["pub.orders"]), ("g.csv", "nothing", 1, 2, ["o_orderkey"]), ("g.csv", "nothing", 1, 99, ["1"])]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    cfg = _cfg(str(tmp_path / "out"), "w1")
    try:
        run(spark, _parsed(spark, rows), X.declared_catalog(spark, SF_SMALL), _store(spark, str(tmp_path / "tables")), cfg)
    finally:
        for k in held:
            spark.conf.unset(k)
    assert tasks[0].n == 600 and tasks[0].tasks > 4
    rejected = spark.read.parquet(cfg.quarantine_path).groupBy("tab", "rule_id").agg(F.count("*").alias("n"), F.min("row_no").alias("lo")).collect()
    got = {(r.tab, r.rule_id): (r.n, r.lo) for r in rejected}
    assert got.pop(("nothing", "C1")) == (1, 99) and got[("update_a", "V1")] == (200, 3)


def test_changes_of_a_row_are_chained_by_one_window(spark, tmp_path, monkeypatch):
    """All columns that tabs change are followed in one pass over the sorted changes."""
    from ferrule.plans import pipeline

    plans, images = [], pipeline._before_images
    monkeypatch.setattr(pipeline, "_before_images", lambda changes, table, cfg: plans.append(
        changes._jdf.queryExecution().optimizedPlan().toString()) or images(changes, table, cfg))
    header = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_flags"]
    rows = [("f.csv", "update_a", 1, 1, ["pub.orders"]), ("f.csv", "update_a", 1, 2, header), ("f.csv", "update_a", 1, 3, ["1", "A", None, "7"]),
            ("f.csv", "update_b", 2, 1, ["pub.orders"]), ("f.csv", "update_b", 2, 2, header[:2]), ("f.csv", "update_b", 2, 3, ["1", "B"]),
            ("f.csv", "update_c", 3, 1, ["pub.orders"]), ("f.csv", "update_c", 3, 2, header[:3]), ("f.csv", "update_c", 3, 3, ["1", None, "c"])]
    store = _store(spark, str(tmp_path / "tables"))
    old = store.read("pub.orders").where("o_orderkey = 1").first()
    cfg = _cfg(str(tmp_path / "out"), "w1")
    run(spark, _parsed(spark, rows), X.declared_catalog(spark, SF_SMALL), store, cfg)
    assert len(plans) == 1 and plans[0].count("Window [") == 1
    new = store.read("pub.orders").where("o_orderkey = 1").first()
    assert (new.o_orderstatus, new.o_orderpriority, new.o_flags, new.o_totalprice) == (None, "c", 7, old.o_totalprice)
    images = {r.item_id[-1]: r.row for r in spark.read.parquet(cfg.locker_path).collect()}
    flags = str(old.o_flags)
    assert {k: (v["o_orderstatus"], v.get("o_orderpriority"), v.get("o_flags")) for k, v in images.items()} == {
        "a": (old.o_orderstatus, old.o_orderpriority, flags), "b": ("A", None, None), "c": ("B", None, None)}


def test_lines_of_a_csv_file_are_not_shuffled(spark, tmp_path):
    from ferrule.sources.workbook import read_inbox

    (tmp_path / "update_a.csv").write_text("pub.orders\no_orderkey\n1\n")
    df = read_inbox(spark, str(tmp_path))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_the_stream_reads_no_contents(spark, tmp_path, monkeypatch):
    """A file of the inbox may be larger than what one row can hold."""
    from ferrule.streaming import inbox as ST

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "update_a.csv").write_text("pub.orders\no_orderkey\n1\n")
    columns, batch = [], ST.parsed_batch
    monkeypatch.setattr(ST, "parsed_batch", lambda files, n: columns.append(files.columns) or batch(files, n))
    ST.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "ckpt"), lambda df, n: df.count())
    assert columns and "content" not in columns[0] and "path" in columns[0]


def test_base_names_are_those_of_the_regular_expression(spark):
    from ferrule.functions import scalars as S

    paths = ["a/b/c.csv", "a\\b/c", "a/b\\c", "c", "", "/", "\\", "a/", "a/b\n", "ä/ö ü", "\n", "//x\\\\y", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(S.base_name("p"), F.regexp_extract("p", r"([^/\\]*)$", 1)).collect()
    assert all(a == b for a, b in got)
