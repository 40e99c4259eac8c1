"""Nested records that are there whole or not at all, and the redacting sink."""

import json
import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graupel.sources import log_sink
from graupel.sources.records import Records

SCHEMA = "id long, name string, parts array<struct<n: int, word: string>>"


def sample(spark, ids, name="r"):
    return spark.createDataFrame([(i, f"{name}{i}", [(k, f"w{k}") for k in range(i % 4)] or None) for i in ids], SCHEMA)


def whole(kept):
    have = {r["id"]: r["name"] for r in kept.rows("id", "name").collect()}
    parts = {}
    for r in kept.children("parts", "owner").collect():
        parts.setdefault(r["owner"], []).append((r["n"], r["word"]))
    assert {i: sorted(p) for i, p in parts.items()} == {i: [(k, f"w{k}") for k in range(i % 4)] for i in have if i % 4}
    return have


@pytest.fixture
def kept(spark, tmp_path):
    return Records(spark, str(tmp_path / "kept"), SCHEMA, "id")


def test_inserts_once_and_keeps_what_is_there(spark, kept):
    assert kept.rows().count() == 0 and kept.children("parts", "owner").count() == 0
    assert kept.insert(sample(spark, range(5))) == 5
    assert kept.insert(sample(spark, range(8), "again").withColumn("more", F.lit(1))) == 3
    assert kept.insert(sample(spark, range(8))) == 0 and kept.insert(sample(spark, [])) == 0
    assert whole(kept) == {i: f"r{i}" if i < 5 else f"again{i}" for i in range(8)}
    assert [f for f in os.listdir(os.path.dirname(kept.path)) if "_new_" in f] == []


def test_commit_cut_off_leaves_no_half_record(spark, kept, tmp_path):
    """As many of a job's files in place as a cut-off commit may have moved."""
    sample(spark, range(40)).repartition(4, "id").write.parquet(str(tmp_path / "job"))
    os.mkdir(kept.path)
    files = sorted(f for f in os.listdir(tmp_path / "job") if f.startswith("part-"))
    for name in files[:2]:
        os.rename(tmp_path / "job" / name, f"{kept.path}/{name}")
        there = len(whole(kept))
        assert 0 < there < 40
    assert kept.insert(sample(spark, range(40))) == 40 - there
    assert whole(kept) == {i: f"r{i}" for i in range(40)} and kept.rows().count() == 40


def test_failures_append_nothing(spark, kept):
    kept.insert(sample(spark, [1]))
    broken = sample(spark, [2, 3]).withColumn("name", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        kept.insert(broken)
    with pytest.raises(Exception, match="a record without id"):
        kept.insert(sample(spark, [4]).withColumn("id", F.lit(None).cast("long")))
    with pytest.raises(ValueError, match="duplicate name: r1"):
        kept.insert(sample(spark, [5]).withColumn("name", F.lit("r1")), unique=["name"])
    with pytest.raises(ValueError, match="duplicate name: x"):
        kept.insert(sample(spark, [6, 7]).withColumn("name", F.lit("x")), unique=["name"])
    assert whole(kept) == {1: "r1"}


def test_a_view_reads_its_array_alone(spark, kept):
    kept.insert(sample(spark, range(4)))
    plan = kept.children("parts", "owner").select("owner", "n")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,parts:array<struct<n:int>>>" in plan


SECRET = "hunter2"


def lines(path):
    return [json.loads(x) for f in sorted(os.listdir(path)) if f.startswith("part-") for x in open(f"{path}/{f}")]


def nowhere(path):
    return not any(SECRET in open(os.path.join(d, f)).read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def log_rows(spark, n, parts=3):
    return spark.range(0, n, 1, parts).select("id", F.lit(SECRET).alias("token"), F.struct(F.struct(F.lit(SECRET).alias("cookie"), F.lit(1).alias("x")).alias("headers")).alias("req"), F.lit(None).cast("string").alias("none"), F.expr("timestamp'2024-01-01'").alias("at"))


def test_sink_redacts_appends_and_overwrites(spark, tmp_path):
    log_sink.register(spark)
    path = str(tmp_path / "log")
    write = lambda df, mode: df.write.format("redacted_log").option("base", '{"service": "s", "jwt": "hunter2"}').mode(mode).save(path)
    write(log_rows(spark, 10), "append")
    write(log_rows(spark, 5), "append")
    got = lines(path)
    assert sorted(r["id"] for r in got) == sorted([*range(10), *range(5)]) and nowhere(path)
    assert {json.dumps({k: r[k] for k in ("service", "jwt", "token", "req", "none")}) for r in got} == {json.dumps({"service": "s", "jwt": "[Redacted]", "token": "[Redacted]", "req": {"headers": {"cookie": "[Redacted]", "x": 1}}, "none": None})}
    write(log_rows(spark, 4), "overwrite")
    assert sorted(r["id"] for r in lines(path)) == [0, 1, 2, 3]
    write(log_rows(spark, 0), "append")
    assert spark.read.json(path).count() == 4 and os.listdir(f"{path}/_tasks") == []


def test_failed_job_leaves_nothing(spark, tmp_path):
    log_sink.register(spark)
    path = str(tmp_path / "log")
    bad = log_rows(spark, 9).withColumn("x", F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.lit("")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("redacted_log").mode("append").save(path)
    assert not os.path.exists(path) or [f for f in os.listdir(path) if f.startswith("part-")] == []


class Task:
    def __init__(self, partition):
        self.partition = partition

    def partitionId(self):
        return self.partition


def attempt(monkeypatch, writer, partition, ids):
    monkeypatch.setattr(log_sink.TaskContext, "get", classmethod(lambda cls: Task(partition)))
    return writer.write(iter([pa.RecordBatch.from_pydict({"id": ids, "token": [SECRET] * len(ids)})]))


def test_retried_tasks_and_batches_write_once(monkeypatch, tmp_path):
    path = str(tmp_path / "log")
    first = log_sink.StreamWriter({"path": path, "stream": "a"})
    attempt(monkeypatch, first, 0, [1, 2])  # lost after it had written
    first.commit([attempt(monkeypatch, first, 0, [1, 2]), attempt(monkeypatch, first, 1, [3]), attempt(monkeypatch, first, 2, []), None], 0)
    assert sorted(r["id"] for r in lines(path)) == [1, 2, 3]
    again = log_sink.StreamWriter({"path": path, "stream": "a"})  # the batch runs again, dealt otherwise
    again.commit([attempt(monkeypatch, again, 0, [1, 2, 3])], 0)
    again.commit([attempt(monkeypatch, again, 0, [4])], 1)
    assert sorted(r["id"] for r in lines(path)) == [1, 2, 3, 4] and nowhere(path)
    assert os.listdir(f"{path}/_tasks") == []


def test_commit_cut_off_between_moves(monkeypatch, tmp_path):
    path = str(tmp_path / "log")
    first = log_sink.StreamWriter({"path": path})
    messages = [attempt(monkeypatch, first, p, [p]) for p in range(3)]
    os.remove(messages[2].file)  # the third move fails
    with pytest.raises(OSError):
        first.commit(messages, 7)
    assert len(lines(path)) == 2
    again = log_sink.StreamWriter({"path": path})
    again.commit([attempt(monkeypatch, again, 5, [0, 1, 2])], 7)
    assert [r["id"] for r in lines(path)] == [0, 1, 2]


def test_stream_into_the_sink(spark, tmp_path):
    log_sink.register(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in (range(3), range(3, 5)):
        log_rows(spark, 1).drop("id", "at").crossJoin(spark.createDataFrame([(i,) for i in ids], "id long")).write.mode("append").json(source)
        stream = spark.readStream.schema("id long, token string, req struct<headers: struct<cookie: string>>").json(source)
        stream.writeStream.format("redacted_log").option("path", path).option("checkpointLocation", f"{tmp_path}/state-{1}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in lines(path)) == [0, 1, 2, 3, 4] and nowhere(path)
    with pytest.raises(ValueError):
        log_sink.StreamWriter({"path": path, "stream": "../x" + uuid.uuid4().hex})
