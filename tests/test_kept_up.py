"""Streams of lines that grow, tables merged batch by batch, listings that read only what has changed."""

import os

import pytest
from pyspark.sql import functions as F

from tracewright.sources import tables
from tracewright.streaming import appended, sessions


def drained(stream, state, take):
    stream.writeStream.option("checkpointLocation", str(state)).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()


def test_a_line_in_two_halves_arrives_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    line = lambda s, k: '{"session": "%s", "seq": %d, "label": "é%d"}\n' % (s, k, k)
    found = []
    take = lambda batch, n: found.append(sorted((r.session, r.seq, r.label) for r in batch.collect()))
    go = lambda: drained(sessions.appended_records(spark, str(folder), suffix=".jsonl"), tmp_path / "state", take)
    whole = line("a", 1)
    a.write_text(line("a", 0) + whole[:20])
    b.write_text("{broken\n" + line("b", 0).replace("\n", "\r\n"))
    (folder / "other.txt").write_text(line("x", 0))
    go()
    with a.open("a") as f:
        f.write(whole[20:] + line("a", 2)[:-1])
    go()
    with a.open("a") as f:
        f.write("\n")
    go()
    a.write_text(line("a", 9))  # shorter than what was read: a new file of that name
    go()
    seen = [r for rows in found for r in rows]
    assert seen == [("a", 0, "é0"), ("b", 0, "é0"), ("a", 1, "é1"), ("a", 2, "é2"), ("a", 9, "é9")]


def test_pieces_split_between_lines(tmp_path):
    path = tmp_path / "x"
    text = "".join(f"{'é' * (k % 7)}{k}\n" for k in range(60)) + "unfinished"
    path.write_bytes(text.encode())
    for size in (1, 3, 17, 10_000):
        reader = appended.Lines(str(tmp_path), "", size)
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
        assert [v for _, _, v in rows] == text.split("\n")[:-1]
        assert [at for _, at, _ in rows] == [len("".join(x + "\n" for x in text.split("\n")[:k]).encode()) for k in range(60)]
    assert list(reader.read(reader.partitions(end, end)[0])) == []


def rows_of(frame):
    return sorted((tuple(r[c] for c in ("session", "n")) for r in frame.collect()), key=str)


def test_batches_merge_once(spark, tmp_path):
    path = f"{tmp_path}/table"
    batch = lambda rows: spark.createDataFrame(rows, "session string, n long")
    assert tables.current(spark, path) is None
    write = sessions.keyed_upsert(spark, path, buckets=8)
    write(batch([(f"s{k}", 0) for k in range(40)] + [(None, 1)]), 0)
    first = tables.versions(spark, path)
    write(batch([("s3", 7), ("new", 1), (None, 2)]), 1)
    want = sorted([*((f"s{k}", 7 if k == 3 else 0) for k in range(40)), ("new", 1), (None, 2)], key=str)
    assert rows_of(tables.current(spark, path)) == want
    after = tables.versions(spark, path)
    moved = {b for b in after if after[b] == 1}
    # Only the buckets of the batch's keys were written.
    assert 1 <= len(moved) <= 3 and {b: v for b, v in after.items() if b not in moved} == {b: v for b, v in first.items() if b not in moved}
    assert sorted(os.listdir(f"{path}/data/v=1")) == sorted(["_SUCCESS", "._SUCCESS.crc", *(f"bucket={b}" for b in moved)])
    write(batch([("s3", 99)]), 1)  # runs again: it is there already
    assert rows_of(tables.current(spark, path)) == want
    # Torn: data without a commit count for nothing, and are written over.
    batch([("s5", 5), ("s6", 6)]).withColumn("bucket", tables.bucket_of("session", 8)).write.partitionBy("bucket").parquet(f"{path}/data/v=2")
    assert rows_of(tables.current(spark, path)) == want
    write(batch([("s3", 8)]), 2)
    want[want.index(("s3", 7))] = ("s3", 8)
    assert rows_of(tables.current(spark, path)) == want
    write(batch([]), 3)
    with pytest.raises(ValueError):
        tables.merge(spark, path, batch([("x", 1)]), "session", 9, buckets=2)
    tables.vacuum(spark, path, keep=1)
    assert rows_of(tables.current(spark, path)) == want and tables.numbers(spark, f"{path}/commits") == [2]


def test_a_stream_into_a_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        with (folder / "log.jsonl").open("a") as f:
            f.write("".join('{"session": "s%d", "seq": %d, "label": "l"}\n' % (j, k) for j in range(k + 1)))
        listing = sessions.running_listing(sessions.appended_records(spark, str(folder)))
        listing.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(sessions.keyed_upsert(spark, f"{tmp_path}/t", buckets=4)).start().awaitTermination()
    assert {r.session: r.records for r in tables.current(spark, f"{tmp_path}/t").collect()} == {"s0": 3, "s1": 2, "s2": 1}


def test_only_changed_logs_are_read(spark, tmp_path):
    logs, state = tmp_path / "logs", f"{tmp_path}/state"
    (logs / "deep").mkdir(parents=True)
    (logs / "a.jsonl").write_text("one\ntwo\n")
    (logs / "deep" / "b.jsonl").write_text("x\n")
    (logs / "empty.jsonl").write_text("")
    (logs / "no.txt").write_text("no\n")
    read = []

    def summary(text):
        read.append(sorted(os.path.basename(r.path) for r in text.select("path").distinct().collect()))
        return text.groupBy("path").agg(F.count("*").alias("lines"), F.min_by("text", "line_no").alias("title"))

    told = lambda: {os.path.basename(r.path): (r.lines, r.title) for r in tables.refreshed(spark, str(logs), state, summary, glob="*.jsonl").collect()}
    assert told() == {"a.jsonl": (2, "one"), "b.jsonl": (1, "x")}
    with (logs / "a.jsonl").open("a") as f:
        f.write("three\n")
    (logs / "c.jsonl").write_text("c\n")
    (logs / "deep" / "b.jsonl").unlink()
    assert told() == {"a.jsonl": (3, "one"), "c.jsonl": (1, "c")}
    assert told() == {"a.jsonl": (3, "one"), "c.jsonl": (1, "c")}
    os.utime(logs / "c.jsonl", (1, 1))
    assert told()["c.jsonl"] == (1, "c")
    assert read == [["a.jsonl", "b.jsonl"], ["a.jsonl", "c.jsonl"], ["c.jsonl"]]
