"""op11: copy-on-write upsert against a plain version on lists, and its parts."""

import hashlib
import math
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from siltstone.llm import upsert
from siltstone.llm.common import new_path

SF = "/root/testdata/sf0.01"
VALUES = ["source", "segment", "city", "balance"]


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def plain(clients: list[dict], changes: list[dict], columns: list[str]) -> list[tuple]:
    """The contract, row by row."""
    m = 1 + len(clients) // 1000
    kept = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [kept[i : i + m] for i in range(0, len(kept), m)]
    firsts = [f[0]["client_id"] for f in files]
    best = {}
    low = lambda x: (x is not None, x or 0)
    for c in changes:
        if c["client_id"] is not None and (c["client_id"] not in best or (low(c["seq"]), low(c["change_id"])) > (low(best[c["client_id"]]["seq"]), low(best[c["client_id"]]["change_id"]))):
            best[c["client_id"]] = c
    state = [{c["client_id"]: c for c in f} for f in files]
    for i, c in best.items():
        if not files:
            break
        home = max((k for k, f in enumerate(firsts) if f <= i), default=0)
        h = crc(firsts[home]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
            state[home].pop(i, None)
        else:
            state[home][i] = (state[home].get(i) or dict.fromkeys(columns) | {"client_id": i}) | {v: c[v] for v in VALUES}
    out = []
    for old, now in zip(files, state):
        new = [now[k] for k in sorted(now)]
        if new == old:
            out.append((False, old))
            continue
        k = math.ceil(len(new) / m)
        at = 0
        for j in range(k):
            size = len(new) // k + (j < len(new) % k)
            part = new[at : at + size]
            at += size
            if out and out[-1][0] and len(out[-1][1]) + size <= m:
                out[-1] = (True, out[-1][1] + part)
            else:
                out.append((True, part))
    rows = []
    for rewritten, f in out:
        cents = sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in f)
        text = sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in f)
        rows.append((f[0]["client_id"], len(f), cents, text, hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(), ",".join(columns), rewritten))
    return rows


def test_op11_equals_a_plain_version(spark):
    clients, changes = (pq.read_table(f"{SF}/{t}.parquet") for t in ("clients", "client_changes"))
    want = plain(clients.to_pylist(), changes.to_pylist(), clients.column_names)
    got = sorted(upsert.op11(spark, SF).collect(), key=lambda r: r["first_id"])
    assert [tuple(r[c] for c in ("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "rewritten")) for r in got] == want
    assert {r["rewritten"] for r in got} == {True, False}
    folder = Path(got[0]["path"]).parent
    assert {str(p) for p in folder.glob("*.parquet")} == {r["path"] for r in got}
    for r in got[:40]:
        t = pq.read_table(r["path"], partitioning=None)
        assert t.num_rows == r["n_rows"] and t.column("client_id").to_pylist() == sorted(t.column("client_id").to_pylist()) and t.schema.types == clients.schema.types


def table(spark, keys, max_rows, **more):
    df = spark.createDataFrame([(k, f"v{k}", "x", "f") for k in keys], "k long, v string, rank string, file string")
    folder = new_path(spark, "upsert-test")
    return folder, df.schema, upsert.write_sorted(df, folder, "k", max_rows)


def apply(spark, folder, schema, files, rows, max_rows):
    changes = upsert.with_home(spark.createDataFrame(rows, "k long, gone boolean, v string"), files, "k")
    after = upsert.upsert(spark, folder, schema, files, changes, "k", ["v"], max_rows)
    return after, [(r["k"], r["v"], r["rank"]) for f in after for r in pq.read_table(f.path.removeprefix("file://")).to_pylist()]


def test_only_files_with_altered_rows_are_rewritten(spark):
    folder, schema, files = table(spark, range(0, 40, 2), 5)
    assert [(f.first, f.last, f.rows) for f in files] == [(0, 8, 5), (10, 18, 5), (20, 28, 5), (30, 38, 5)]
    rows = [(3, True, None), (12, False, "v12"), (21, False, "new"), (22, True, None), (500, True, None), (-4, False, None), (None, False, "n")]
    after, now = apply(spark, folder, schema, files, rows, 5)
    assert [f.path in {x.path for x in files} for f in after] == [False, False, True, False, True]  # -4 splits the first file, 21 and 22 change the third
    assert [f.rows for f in after] == [3, 3, 5, 5, 5]
    want = sorted([(k, f"v{k}", "x") for k in range(0, 40, 2) if k != 22] + [(21, "new", None), (-4, None, None)])
    assert now == want and after[0].columns == "k,v,rank,file"


def test_files_may_vanish_and_neighbours_join(spark):
    folder, schema, files = table(spark, range(12), 3)
    after, now = apply(spark, folder, schema, files, [(k, True, None) for k in (0, 1, 3, 4, 5, 6)], 3)
    assert [f.rows for f in after] == [3, 3] and [r[0] for r in now] == [2, 7, 8, 9, 10, 11] and after[1].path == files[3].path


def test_an_empty_table_and_no_changes(spark):
    folder, schema, files = table(spark, [], 3)
    assert files == []
    after, now = apply(spark, folder, schema, files, [(k, False, str(k)) for k in range(7)] + [(9, True, None)], 3)
    assert [f.rows for f in after] == [3, 2, 2] and [r[0] for r in now] == list(range(7))
    same, now = apply(spark, folder, schema, after, [], 3)
    assert [f.path for f in same] == [f.path for f in after] and len(now) == 7


def test_repeated_keys_over_files_meet_a_change_everywhere(spark):
    folder, schema, files = table(spark, [1, 2, 2, 2, 2, 2, 3, None], 2)
    assert files[0].first == 1 and files[0].rows == 2
    after, now = apply(spark, folder, schema, files, [(2, False, "z"), (3, True, None)], 2)
    assert sorted(r[1] for r in now if r[0] == 2) == ["z"] * 5 and {r[0] for r in now} == {None, 1, 2}


def test_a_hot_home_takes_many_inserts(spark):
    folder, schema, files = table(spark, range(10), 5)
    after, now = apply(spark, folder, schema, files, [(k, False, "n") for k in range(10, 210)], 5)
    assert [r[0] for r in now] == list(range(210)) and max(f.rows for f in after) <= 5 and len(after) == 42


def test_bloom_filters_hold_all_keys_and_few_others():
    import numpy as np

    ids = np.arange(0, 20000, 2)
    bits = upsert.bloom(ids)
    assert upsert.may_hold(ids, bits).all() and upsert.may_hold(ids + 1, bits).mean() < 0.02
    assert not upsert.may_hold(np.array([5, 6]), upsert.bloom(ids[:0])).any()


def test_layout():
    assert upsert.layout(3, {0: 11, 2: 0}, 5) == [4, 4, 3, None]
    assert upsert.layout(4, {0: 2, 1: 0, 2: 3, 3: 1}, 5) == [5, 1]
    assert upsert.layout(2, {}, 5) == [None, None]


def test_winners(spark):
    rows = [(1, None, 9, "a"), (1, 0, 1, "b"), (1, 0, 2, "c"), (1, 0, 2, "c"), (None, 5, 5, "d"), (2, None, None, None)]
    got = upsert.winners(spark.createDataFrame(rows, "k long, seq long, c long, op string"), "k", ["seq", "c"], ["op"]).collect()
    assert sorted((r["k"], r["op"]) for r in got) == [(1, "c"), (2, None)]


@pytest.mark.parametrize("table_name", ["clients", "client_changes"])
def test_op11_on_an_empty_table(spark, tmp_path, table_name):
    for t in ("clients", "client_changes"):
        x = pq.read_table(f"{SF}/{t}.parquet")
        pq.write_table(x.slice(0, 0) if t == table_name else x, tmp_path / f"{t}.parquet")
    got = upsert.op11(spark, str(tmp_path)).collect()
    assert got == [] if table_name == "clients" else not any(r["rewritten"] for r in got) and len(got) > 100
