import hashlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexifold.llm import exact

DOCS = [(i % 40, t) for i, t in enumerate(["", None, "a", "a ", "A", "é", "long " * 50_000, "long " * 50_000, *(f"text {i % 7}" for i in range(60))])] + [(None, "a"), (None, None), (3, "a"), (3, "a")]


def put(folder, name, docs, **more):
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string())} | more), folder / name)
    return str(folder)


def plainly(docs):
    texts = defaultdict(list)
    for i, t in docs:
        texts[t or ""].append(-1 if i is None else i)
    out = []
    for t, ids in texts.items():
        keep = max(ids)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out)


def told(rows, digest=True):
    rows = rows.collect()
    none = lambda i: -1 if i is None else i
    kept = [r for r in rows if r["kept"]]
    assert all(r["id"] == r["keep_id"] for r in kept)
    return sorted((none(r["id"]), none(r["keep_id"]), r["group_size"], *[r["digest"]] * digest) for r in rows), len(kept)


def weak(text):
    return F.crc32(text.cast("binary")) % 2


@pytest.mark.parametrize("files", [1, 2, 3])
def test_batches_are_one_table(spark, tmp_path, files):
    for n, part in enumerate((DOCS[:20], DOCS[20:45], DOCS[45:])):
        path = put(tmp_path, f"{n}.parquet", part)
    got, kept = told(exact.dedup(spark, path, files=files))
    assert got == plainly(DOCS) and kept == len({t or "" for _, t in DOCS})


def test_bytes_decide_where_digests_are_equal(spark, tmp_path):
    path = put(tmp_path, "0.parquet", DOCS)
    got, kept = told(exact.dedup(spark, path, digest=weak), digest=False)
    assert got == [x[:3] for x in plainly(DOCS)] and kept == len({t or "" for _, t in DOCS})


def test_started_again_on_one_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = put(tmp_path / "in", "0.parquet", DOCS[:30])
    one = exact.ExactDedup(spark, path, str(tmp_path / "kept"))
    assert told(one.take().result())[0] == plainly(DOCS[:30])
    put(tmp_path / "in", "1.parquet", DOCS[30:])
    again = exact.ExactDedup(spark, path, str(tmp_path / "kept")).take()
    assert told(again.result())[0] == plainly(DOCS)
    changed = spark.read.parquet(str(tmp_path / "kept/batches")).where("batch = 1")
    assert changed.where(F.col("n") > 1).count() > 0  # the second start went on from the state of the first
    assert told(again.take().result())[0] == plainly(DOCS)  # nothing new
    state = spark.read.format("statestore").load(str(tmp_path / "kept/state"))
    assert {(r[0], r[1]) for r in state.select("key.digest", "value.count").collect()} == {(d, n) for _, _, n, d in plainly(DOCS)}


def test_a_batch_played_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = put(tmp_path / "in", "0.parquet", DOCS)
    one = exact.ExactDedup(spark, path, str(tmp_path / "kept")).take()
    for commit in (tmp_path / "kept/state/commits").iterdir():  # as if the driver had died before the batch was committed
        commit.unlink()
    assert told(one.take().result())[0] == plainly(DOCS)


def test_empty_and_clashing(spark, tmp_path):
    path = put(tmp_path, "0.parquet", [])
    assert exact.dedup(spark, path).collect() == []
    other = tmp_path / "more"
    other.mkdir()
    path = put(other, "0.parquet", DOCS, digest=pa.array([1] * len(DOCS)), locator=pa.array(["x"] * len(DOCS)), n=pa.array([1] * len(DOCS)))
    assert told(exact.dedup(spark, path))[0] == plainly(DOCS)


def test_the_query(spark):
    got = sorted(map(tuple, exact.op11_streaming_dedup(spark, "/root/testdata/sf0.001").collect()))
    want = duckdb.sql(exact.ORACLE_SQL.replace("FROM documents", "FROM '/root/testdata/sf0.001/documents.parquet'")).fetchall()
    assert got == sorted(want)


def test_the_provider_comes_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    exact.dedup(spark, put(tmp_path, "0.parquet", DOCS))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
