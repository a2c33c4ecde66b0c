import itertools
import json
import random
from collections import Counter

import duckdb
import pytest

from ferrule.llm import audit
from ferrule.llm.queries import OP12_SQL, QUERIES
from tools.oracle_check import digest

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def fails(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    return {f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                             ("C", 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)), ("D", any(c in "#$%&*|" for c in text))) if bad}


def brute(docs, labels):
    """Runs every order, document by document."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        repeated = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((source or "", i, fails(text or "") | ({"E"} if repeated else set())))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                mine = [r for r in rows if r[0] == part and f in r[2]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(mine) - len(gone), sum(r[2] == {f} for r in mine),
                                          sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, folder, labels, files=None):
    out = audit.audit_files(spark, folder, spark.createDataFrame(labels, LABELS), files)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = out.collect()
    assert len(rows) == len({r[:3] for r in rows})
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def corpus(rnd, n):
    some = [" ".join(rnd.choice(["a", "bc", "D", "é", "x#"][:rnd.randint(1, 5)]) + rnd.choice(["", str(rnd.randint(0, 300))])
                     for _ in range(rnd.choice([3, 150, 220, 260]))) for _ in range(25)]
    some += [None, "", "a\tb\nc\vd\fe\rf", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "É" * 60 + " ABC",
             " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 101}" for i in range(203)), "A" + "b" * 49, "A" + "b" * 48]
    return [(rnd.choice([rnd.randint(0, 300), rnd.randint(0, 300), None]), rnd.choice(some), rnd.choice(["s", "t", None, ""])) for _ in range(n)]


def test_orders_match_brute_force_whatever_comes_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "TEXTS", 8)
    rnd = random.Random(5)
    docs = corpus(rnd, 160)
    labels = [(rnd.randint(0, 300), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(250)] + [(None, 1, 1)]
    want = brute(docs, labels)
    for name, by in (("up", 1), ("down", -1)):
        folder = f"{tmp_path}/{name}"
        docs.sort(key=lambda r: by * (r[0] or 0))
        for i in range(0, len(docs), 40):  # four files, one a batch
            spark.createDataFrame(docs[i:i + 40], DOCS).coalesce(1).write.mode("append").parquet(folder)
        assert found(spark, folder, labels, 1) == want
    assert found(spark, folder, labels) == want


def test_smaller_ids_take_back_what_was_counted():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, counts = State(), Counter()
    rows = [("s", 0, True, 9, 1, 3), ("t", 1, True, 5, 2, 2), ("s", 0, True, 5, 1, 1), ("s", 2, True, 7, 1, 1), ("u", 0, False, 0, 4, 4), ("t", 0, True, 2, 1, 2)]
    for row in rows:
        frame = pd.DataFrame([(b"x", 3, *row), (b"y", 0, "s", 0, True, 1, 1, 1)],
                             columns=["digest", "mask", "part", "flags", "has_id", "first", "n_first", "n"])
        for out in audit._retract((7,), iter([frame]), state):
            for part, mask, flags, change in out.itertuples(index=False):
                counts[part, mask, flags] += change
    assert counts.pop(("s", 0, 0)) == len(rows)  # the other text's one id, again and again
    assert +counts == Counter({("s", 19, 0): 4, ("t", 19, 1): 2, ("s", 19, 2): 1, ("u", 3, 0): 4, ("t", 3, 0): 1, ("t", 19, 0): 1})
    assert dict((d, first) for d, first, _ in json.loads(state.get[0])) == {b"x".hex(): 2, b"y".hex(): 1} and min(counts.values()) >= 0


def test_a_hot_text_is_combined(spark, tmp_path):
    docs = [(i, "same text", f"s{i % 3}") for i in range(3000, 0, -1)] + [(i, f"other {i}", "s0") for i in range(4000, 4100)]
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{tmp_path}/docs")
    got = found(spark, f"{tmp_path}/docs", [(1, 1, 0), (2, 0, 1)], 2)
    assert got["s1", "EABCD", 1] == (1, 999, 0, 0, 0, 0, 999 * 60)
    assert got["s0", "EABCD", 1][:2] == (100, 1000) and got["s2", "EABCD", 1] == (0, 1000, 0, 0, 0, 1, 1000 * 60)
    assert got["s1", "ABCDE", 1][:2] == (0, 1000) and got["s1", "ABCDE", 5] == (0, 0, 999, 0, 0, 0, 999 * 60)


def test_empty_table_extra_columns_and_session_settings(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none")
    assert found(spark, f"{tmp_path}/none", []) == {}
    spark.createDataFrame([(1, "a #", "s", "x", 3)], DOCS + ", part string, mask int").write.parquet(f"{tmp_path}/one")
    assert found(spark, f"{tmp_path}/one", []) == brute([(1, "a #", "s")], [])
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_long_texts_in_pieces(monkeypatch):
    text = ("word " * 300 + "é\tü " * 50 + "END").encode()
    whole = audit.own_mask(text)
    monkeypatch.setattr(audit, "PIECE", 7)
    assert audit.own_mask(text) == whole == sum(1 << "ABCD".index(f) for f in fails(text.decode()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df, res = QUERIES["op12_audit"](spark, f"/root/testdata/{sf}"), con.sql(OP12_SQL)
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert rows and digest(df.columns, rows)[0] == digest(res.columns, want)[0]
