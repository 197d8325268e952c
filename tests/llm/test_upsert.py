import hashlib
import random
import zlib
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import upsert

CLIENT = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"


def local(path):
    return urlparse(path).path


def crc(x):
    return zlib.crc32(str(x).encode())


def brute(clients, changes, m):
    """(first_id, n_rows, cents, rows_crc, ids, rewritten) of the files, with clients and changes as dicts."""
    base = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [base[i : i + m] for i in range(0, len(base), m)]
    firsts = [f[0]["client_id"] for f in files]
    best = {}
    for c in changes:
        if c["client_id"] is not None:
            rank = lambda c: tuple(-1 if c[k] is None else c[k] for k in ("seq", "change_id"))
            if c["client_id"] not in best or rank(c) > rank(best[c["client_id"]]):
                best[c["client_id"]] = c
    new = [{r["client_id"]: r for r in f} for f in files]
    for key, c in best.items():
        if not files:
            break
        home = max([i for i, f in enumerate(firsts) if f <= key], default=0)
        h = crc(firsts[home]) % 12
        if h > 7:
            continue
        if c["op"] == "D" or (c["change_id"] is not None and crc(c["change_id"]) % 8 < h):
            new[home].pop(key, None)
        else:
            old = new[home].get(key, dict.fromkeys(clients[0]) | {"client_id": key})
            new[home][key] = old | {k: c[k] for k in upsert.SET}
    out = []
    for old, rows in zip(files, new, strict=True):
        rows = [rows[k] for k in sorted(rows)]
        if rows == old:
            out.append((old, False))
            continue
        k = -(-len(rows) // m)
        at = 0
        for i in range(k):
            size = len(rows) // k + (i < len(rows) % k)
            part = rows[at : at + size]
            at += size
            if out and out[-1][1] and len(out[-1][0]) + len(part) <= m:
                out[-1] = (out[-1][0] + part, True)
            else:
                out.append((part, True))
    cents = lambda r: 0 if r["balance"] is None else int((100 * r["balance"] + 0.5) // 1)
    row_crc = lambda r: crc("|".join(r[k] or "" for k in ("source", "segment", "city")))
    return [(rows[0]["client_id"], len(rows), sum(map(cents, rows)), sum(map(row_crc, rows)), hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest(), new) for rows, new in out]


def made(rng, n, n_changes, ids):
    word = lambda *w: rng.choice([*w, None])
    client = lambda i: dict(client_id=i, master_id=i, source=word("web", "crm"), updated_at=None, name=f"n{i}", email=None, city=word("Ilar", "É", ""), nation_id=rng.randrange(25), segment=word("retail"), balance=rng.choice([None, -444.15, 0.005, rng.uniform(-99, 999)]))
    clients = [client(i) for i in rng.sample(ids, n)]
    changes = [
        dict(change_id=rng.choice([j, j, j, None]), client_id=rng.choice([*ids[:: max(1, len(ids) // 200)], None, 7]), seq=rng.choice([None, *range(20)]), op=rng.choice(["U", "U", "I", "D", None]), valid_at=None, source=word("web", "crm"), segment=word("retail"), city=word("Ilar"), balance=rng.choice([None, 5.0, float(j)]))
        for j in range(n_changes)
    ]
    # The winner of a client has to be one change.
    seen, kept = set(), []
    for c in changes:
        name = (c["client_id"], c["seq"], c["change_id"])
        if name not in seen:
            seen.add(name)
            kept.append(c)
    # Some changes write what is there already.
    kept += [dict(change_id=10_000 + c["client_id"], client_id=c["client_id"], seq=99, op="U", valid_at=None, **{k: c[k] for k in upsert.SET}) for c in clients[::3]]
    return clients, kept + kept[:5]


def report(spark, clients, changes):
    tables = [spark.createDataFrame([tuple(r.values()) for r in rows], schema) for rows, schema in ((clients, CLIENT), (changes, CHANGE))]
    return upsert.report(tables[0].repartition(3), tables[1].withColumn("row", F.lit(1)).withColumn("key", F.lit(2)))


@pytest.mark.parametrize(("seed", "n", "n_changes"), [(1, 900, 400), (4, 1500, 3000)])
def test_equals_brute_force(spark, monkeypatch, seed, n, n_changes):
    monkeypatch.setattr(upsert, "SHARE", 15)
    rng = random.Random(seed)
    clients, changes = made(rng, n, n_changes, list(range(-500, 2000)))
    got = sorted(report(spark, clients, changes).collect(), key=lambda r: r["first_id"])
    assert [tuple(r[c] for c in ("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "rewritten")) for r in got] == brute(clients, changes, 1 + n // 15)
    assert {r["columns"] for r in got} == {"client_id,master_id,source,updated_at,name,email,city,nation_id,segment,balance"}
    # The files are there, alone, sorted and with these rows.
    folder = Path(local(got[0]["path"])).parent
    assert {str(p) for p in folder.rglob("*.parquet")} == {local(r["path"]) for r in got}
    for r in got:
        ids = pq.read_table(local(r["path"]))["client_id"].to_pylist()
        assert ids == sorted(ids)
        assert hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() == r["ids_sha256"]


def test_empty_tables(spark):
    clients, changes = made(random.Random(5), 30, 30, list(range(100)))
    assert report(spark, clients[:1], changes[:1]).count() <= 1
    one = spark.createDataFrame([tuple(clients[0].values())], CLIENT)
    none = spark.createDataFrame([tuple(r.values()) for r in changes], CHANGE)
    assert upsert.report(one.where("false"), none).count() == 0
    whole = spark.createDataFrame([tuple(r.values()) for r in clients], CLIENT)
    assert {r["rewritten"] for r in upsert.report(whole, none.where("false")).collect()} == {False}


@pytest.mark.parametrize("bins", [60, 1 << 14])
def test_order_statistics_are_exact(spark, bins):
    rng = random.Random(6)
    for keys in ([5], [-(1 << 63), (1 << 63) - 1, 0], rng.sample(range(-(10**12), 10**12), 300), [3] * 50 + list(range(40)) + [1 << 40] * 20):
        df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
        ranks = list(range(0, len(keys), 7))
        assert upsert.order_statistics(df, ranks, bins) == [sorted(keys)[r] for r in ranks]


def test_layout():
    assert upsert.layout([10, 10, 10], set(), 10) == []
    assert upsert.layout([23, 10, 0, 3, 4], {0, 2, 3, 4}, 10) == [8, 8, 7, 7]
    assert upsert.layout([4, 5, 2, 9], {0, 1, 2, 3}, 10) == [9, 2, 9]
    assert upsert.layout([4, 0, 5], {0, 1, 2}, 10) == [9]


def test_all_inserts_at_the_end_and_everything_deleted(spark):
    base = spark.range(0, 100, 5).selectExpr("id AS `k.k`", "map(1, 'x') AS m", "'old' AS v")
    files = upsert.write_sorted(base, "k.k", 6)
    assert [len(pq.read_table(local(p))) for p in files.paths] == [6, 6, 6, 2]
    new = spark.range(1000, 3000).selectExpr("id AS key", "false AS delete", "struct('new' AS v) AS set")
    after = files.upsert(new)
    sizes = [len(pq.read_table(local(p))) for p in after.paths]
    assert sizes == [6, 6, 6] + upsert.layout([6, 6, 6, 2002], {3}, 6)
    assert after.read().where("v = 'new' AND m IS NULL").count() == 2000
    assert after.read().columns == ["k.k", "m", "v"]
    gone = after.upsert(after.read().selectExpr("`k.k` AS key", "true AS delete", "struct('new' AS v) AS set"))
    assert gone.paths == []
    assert gone.read().count() == 0


def test_repeated_keys_stay_together(spark):
    base = spark.range(40).selectExpr("id % 4 AS k", "id AS v")
    files = upsert.write_sorted(base, "k", 7)
    assert files.read().count() == 40
    after = files.upsert(spark.createDataFrame([(2, False, (9,)), (3, True, (0,))], "key long, delete boolean, set struct<v: long>"))
    assert {(r["k"], r["v"]) for r in after.read().collect() if r["k"] == 2} == {(2, 9)}
    assert after.read().groupBy("k").count().count() == 3
