"""Stored tables: changes read back, owners, versions, and writers side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from mendwright.operators.stored import Conflict, StoredTable

SCHEMA = "id long, who string, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(spark, tmp_path, rows=((1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, None, "z")), buckets=4):
    return StoredTable.create(spark.createDataFrame(list(rows), SCHEMA), f"file://{tmp_path}/t", "id", "who", buckets)


def test_changes_are_read_back(spark, tmp_path):
    t = made(spark, tmp_path)
    first = t.read()
    assert t.upsert(spark.createDataFrame([("new", 2, "b"), ("five", 5, "a")], "text string, id int, who string")) == 1
    assert rows_of(t.read()) == [(1, "a", "x"), (2, "b", "new"), (3, "b", None), (4, None, "z"), (5, "a", "five")]
    assert t.update(spark.createDataFrame([(1,), (3,), (99,)], "id long"), {"text": F.concat(F.lit("was "), F.coalesce("text", F.lit("null")))}) == 2
    assert t.delete(spark.createDataFrame([(4,), (77,)], "id long")) == 3
    assert rows_of(t.read()) == [(1, "a", "was x"), (2, "b", "new"), (3, "b", "was null"), (5, "a", "five")]
    assert rows_of(t.read(0)) == rows_of(first) == [(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, None, "z")]
    assert rows_of(t.get(2)) == [(2, "b", "new")] and rows_of(t.get(4)) == [] and t.get(2, "a").isEmpty()
    assert t.read().schema.simpleString() == "struct<id:bigint,who:string,text:string>"


def test_owners(spark, tmp_path):
    t = made(spark, tmp_path)
    t.upsert(spark.createDataFrame([(1, "liar", "mine"), (3, "a", "taken"), (9, None, "new")], SCHEMA), who="a")
    assert rows_of(t.read()) == [(1, "a", "mine"), (2, "a", "y"), (3, "b", None), (4, None, "z"), (9, "a", "new")]
    t.delete(spark.createDataFrame([(k,) for k in range(10)], "id long"), who="b")
    t.update(spark.createDataFrame([(k,) for k in range(10)], "id long"), {"text": "set"}, who="a")
    assert rows_of(t.read()) == [(1, "a", "set"), (2, "a", "set"), (4, None, "z"), (9, "a", "set")]
    assert rows_of(t.owned("a")) == [(1, "a", "set"), (2, "a", "set"), (9, "a", "set")]


def test_faulty_and_empty_changes(spark, tmp_path):
    t = made(spark, tmp_path)
    for faulty in ([(None, "a", "x")], [(7, "a", "x"), (7, "a", "x")]):
        with pytest.raises(ValueError):
            t.upsert(spark.createDataFrame(faulty, SCHEMA))
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == 0 and t.version() == 0
    with pytest.raises(FileExistsError):
        made(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        StoredTable(spark, f"file://{tmp_path}/none").read()
    empty = StoredTable.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e", "id")
    assert empty.read().isEmpty() and empty.upsert(spark.createDataFrame([(1, "a", "x")], SCHEMA)) == 1 and rows_of(empty.read()) == [(1, "a", "x")]
    assert empty.delete(spark.createDataFrame([(1,)], "id long")) == 2 and empty.read().isEmpty()


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = made(spark, tmp_path, [(k, "a", str(k)) for k in range(200)], buckets=16)
    before = t._manifest(0)["folders"]
    t.upsert(spark.createDataFrame([(5, "a", "five")], SCHEMA))
    after = t._manifest(1)["folders"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert t.vacuum(keep=5) == 0 and t.read(0).count() == 200
    for k in range(16):
        t.update(spark.createDataFrame([(5,)], "id long"), {"text": str(k)})
    assert t.vacuum(keep=1) >= 15 and t.get(5).first()["text"] == "15" and t.read().count() == 200


def test_writers_side_by_side(spark, tmp_path):
    t = made(spark, tmp_path, [(k, "a", "0") for k in range(40)])
    faults = []

    def work(n):
        try:
            own = StoredTable(spark, t.path)
            for k in range(2):
                own.upsert(spark.createDataFrame([(100 * n + k, "w", str(n)), (n, "a", "changed")], SCHEMA))
                # a count that all writers share: no increment may be lost
                own.update(spark.createDataFrame([(39,)], "id long"), {"text": F.col("text").cast("int") + 1})
        except Exception as e:  # noqa: BLE001
            faults.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not faults
    rows = {r["id"]: r["text"] for r in t.read().collect()}
    assert rows[39] == "6" and t.version() == 12 and len(rows) == 46
    assert all(rows[100 * n + k] == str(n) and rows[n] == "changed" for n in range(1, 4) for k in range(2))


def test_a_writer_gives_up(spark, tmp_path, monkeypatch):
    t = made(spark, tmp_path)
    t.tries = 2
    monkeypatch.setattr(StoredTable, "_take", lambda *a: False)
    with pytest.raises(Conflict):
        t.delete(spark.createDataFrame([(1,)], "id long"))
