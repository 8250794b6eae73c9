"""Files cut anywhere, and a cache that survives what breaks off."""

import datetime
import random

import pytest

from murmurlake.operators.candidates import distinct_addresses
from murmurlake.sources import cache, sinks
from murmurlake.sources.chat import parse_chats, parse_lines, read_chat_lines

STAMP = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("size", ["900b", "1m"])
def test_lines_don_t_depend_on_where_files_are_cut(spark, tmp_path, size):
    rng = random.Random(1)
    chats = {}
    for name in ("a", "b", "c"):
        lines = [f"1/{rng.randint(1, 28)}/24, 10:{i % 60:02} - {rng.choice(['Ann', 'Zoë'])}: it’s {'word ' * rng.randint(0, 90)}{i}" if rng.random() < 0.7 else rng.choice(["", "more ünder", "x" * 300]) for i in range(80)]
        chats[name] = lines + ["end"]
        (tmp_path / f"{name}.txt").write_text(("\r\n" if name == "b" else "\n").join(chats[name]))
    (tmp_path / "d.txt").write_text("Jan 2, 2024 10:00:00 AM\n+123\nhello\nthere")
    chats["d"] = ["Jan 2, 2024 10:00:00 AM", "+123", "hello", "there"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = read_chat_lines(spark, str(tmp_path))
        rows = found.collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["line_no"]):
            got.setdefault(r["chat_id"].rsplit("/", 1)[1][0], []).append((r["line_no"], r["text"]))
        assert got == {k: [(i, t.replace("’", "'")) for i, t in enumerate(v)] for k, v in chats.items()}
        whole = parse_chats(spark.createDataFrame([(k, "\n".join(v)) for k, v in chats.items()], "chat_id string, content string"))
        names = [c for c in whole.columns if c != "chat_id"]
        want = sorted(repr((r["chat_id"], *[r[c] for c in names])) for r in whole.collect())
        for by_ranges in (False, True):
            made = parse_lines(found, by_ranges).collect()
            assert sorted(repr((r["chat_id"].rsplit("/", 1)[1][0], *[r[c] for c in names])) for r in made) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def _rows(spark, rows):
    return spark.createDataFrame([(k, d, STAMP + datetime.timedelta(days=t)) for k, d, t in rows], cache.SCHEMA)


def test_cache_keeps_the_newest_and_reads_what_is_asked(spark, tmp_path):
    known = cache.ResponseCache(spark, str(tmp_path / "cache"), buckets=8)
    assert known.read().count() == 0
    known.put(_rows(spark, [(f"k{i}", f"old {i}", 0) for i in range(50)]))
    known.put(_rows(spark, [("k1", "new", 2), ("k2", None, 2), ("k3", "b", 0), ("k3", "a", 0), ("k4", None, 0)]))
    want = {f"k{i}": f"old {i}" for i in range(50)} | {"k1": "new", "k2": None, "k3": "old 3"}

    def held():
        return {r["key"]: r["data"] for r in known.read().collect()}

    assert held() == want
    asked = known.lookup(spark.createDataFrame([("k1",), ("k2",), ("none",), ("k1",)], "key string"))
    assert {(r["key"], r["data"], r["hit"]) for r in asked.collect()} == {("k1", "new", True), ("k2", None, True), ("none", None, False)}
    one = known.lookup(spark.createDataFrame([("k7",)], "key string"))
    assert one.first()["data"] == "old 7" and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket")
    known.compact()
    assert known.generation() == 1 and held() == want
    known.put(_rows(spark, [("k9", "after", 3)]))
    assert held() == want | {"k9": "after"}
    known.clear()
    assert held() == {} and known.generation() == 0


@pytest.mark.parametrize("breaks", ["_write", "_drop_before"])
def test_compaction_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch, breaks):
    known = cache.ResponseCache(spark, str(tmp_path / "cache"), buckets=4)
    known.put(_rows(spark, [("a", "1", 0), ("b", "2", 0), ("a", "3", 1)]))
    whole = getattr(cache.ResponseCache, breaks)

    def stops(self, *args):
        if breaks == "_write":
            whole(self, args[0].limit(1), *args[1:])  # a part of the new generation is there
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(cache.ResponseCache, breaks, stops)
        with pytest.raises(OSError, match="lost"):
            known.compact()
    want = {"a": "3", "b": "2"}
    assert {r["key"]: r["data"] for r in known.read().collect()} == want
    known.put(_rows(spark, [("c", "4", 0)]))
    known.compact()
    assert {r["key"]: r["data"] for r in known.read().collect()} == want | {"c": "4"}


def test_addresses_by_where_they_stand_first(spark):
    entry = "array<struct<content:string>>"
    rows = [
        ("b", 0, "see https://b.example.", None, []), ("a", 1, "https://one.example and https://two.example", [("before https://zero.example",)], [(None,)]),
        ("a", 2, None, [("https://two.example",)], [("https://last.example",)]),
    ]
    df = spark.createDataFrame(rows, f"chat_id string, message_id long, content string, context_before {entry}, context_after {entry}")
    got = [r["url"] for r in distinct_addresses(df).orderBy("place").collect()]
    assert got == [f"https://{x}.example" for x in ("zero", "one", "two", "last", "b")]


def test_json_comes_back_and_runs_are_listed(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS ord, 'a' AS activity, array(named_struct('id', 3L, 'timestamp', timestamp'2024-03-05 10:00:01.5', 'sender', 's', 'message', 'm')) AS messages")
    path = str(tmp_path / "out")
    sinks.write_json(rows, path)
    assert [r.asDict(True) for r in sinks.read_json(spark, path).select(rows.columns).collect()] == [r.asDict(True) for r in rows.collect()]
    for key in ("first", "second"):
        cache.Stages(spark, str(tmp_path / "runs"), key).put("rows", rows)
    assert set(cache.Stages.runs(spark, str(tmp_path / "runs"))) == {"first", "second"} and cache.Stages.runs(spark, str(tmp_path / "none")) == []
