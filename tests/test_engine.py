"""The stage graph with a classifier that answers by rule."""

import datetime

from pyspark.sql import functions as F

from murmurlake.operators.filters import ExportFilter
from murmurlake.plans.engine import Engine
from murmurlake.sources import sinks
from murmurlake.sources.cache import ResponseCache, Stages

CHAT = "\n".join(f"1/{d}/24, 10:0{d} - {'Ann' if d % 2 else 'Bob'}: {t}" for d, t in enumerate(["we should go to the beach", "ok", "let's try the new cafe", "hello"], 1))


def answers(prompts):
    item = F.transform("expected_ids", lambda i: F.concat(F.lit('{"msg": '), i.cast("string"), F.lit(', "title": "go to the beach", "fun": 4, "int": "3.5", "cat": "nature", "city": "Napier"}')))
    return prompts.select("batch_id", "expected_ids", F.concat(F.lit("["), F.array_join(item, ","), F.lit("]")).alias("response"))


def test_engine(spark, tmp_path):
    chats = spark.createDataFrame([("a", CHAT), ("b", "1/1/24, 10:00 - Cy: hello")], "chat_id string, content string")
    places = spark.createDataFrame([("geocode", "Napier", "OK", -39.5, 176.9, "p1")], "kind string, query string, status string, latitude double, longitude double, place_id string")
    engine = Engine(spark, chats, answers, places, stages=Stages(spark, str(tmp_path / "runs"), "r1"))
    assert [r["content"] for r in engine.get("candidates").orderBy("message_id").collect()] == ["we should go to the beach", "let's try the new cafe"]
    prompt = engine.get("prompts").first()["prompt"]
    assert ">>> [Jan 1, 2024" in prompt and "Bob: ok" in prompt
    rows = engine.export(ExportFilter(categories=("Nature",), only_locations=True)).collect()
    assert [(r["activity"], len(r["messages"]), r["latitude"], r["place_lookup_source"], r["score"]) for r in rows] == [("Go to the beach", 2, -39.5, "geocode", 3.7)]
    assert rows[0]["messages"][0]["timestamp"] == datetime.datetime(2024, 1, 1, 10, 1)
    assert sinks.pdf_bytes(engine.get("geocoded"), "Plans").startswith(b"%PDF-1.4")
    again = Engine(spark, chats, lambda _: 1 / 0, places, stages=Stages(spark, str(tmp_path / "runs"), "r1"))
    assert again.get("geocoded").count() == 1  # every stage was read back


def test_offsets_mean_context(spark):
    import pytest

    at = datetime.datetime(2024, 1, 1)
    near = "array<struct<id:long,sender:string,content:string,timestamp:timestamp>>"
    row = ("a", 5, "Ann", "go", at, [(3, "Bob", "far", at), (4, "Bob", "near", at)], [(6, "Bob", "next", at)])
    contexts = spark.createDataFrame([row], f"chat_id string, message_id long, sender string, content string, timestamp timestamp, context_before {near}, context_after {near}")
    prompts = spark.createDataFrame([("a#0", "?", [5])], "batch_id string, prompt string, expected_ids array<long>")

    def said(offset, strict=True):
        text = F.lit('[{"msg": 5, "title": "beach", "off": %d}]' % offset)
        engine = Engine(spark, None, lambda asked: asked.select("batch_id", "expected_ids", text.alias("response")), None, fail_outside=strict)
        engine.built = {"contexts": contexts, "prompts": prompts}
        return [(m["id"], m["message"]) for m in engine.get("activities").first()["messages"]]

    assert [said(n) for n in (0, -1, -2, 1)] == [[(5, "go")], [(4, "near")], [(3, "far")], [(6, "next")]]
    for offset in (2, -3):
        with pytest.raises(Exception, match="no context at offset"):
            said(offset)
        assert said(offset, strict=False) == [(5, "go")]


def test_command_line_exports(spark, tmp_path):
    import json

    from murmurlake import cli

    said = [(1, datetime.datetime(2024, 1, 1), "Ann", "let's go")]
    kind = "ord long, activity string, category string, score double, place_name string, place_query string, city string, region string, country string, latitude double, longitude double, place_id string, place_lookup_source string, messages array<struct<id:long,timestamp:timestamp,sender:string,message:string>>"
    rows = [(1, "Beach", "nature", 3.0, None, None, "Napier", None, "NZ", -39.5, 176.9, "p", "geocode", said), (2, "Film", "movie", 4.0, None, None, None, None, None, None, None, None, None, said)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    (tmp_path / "c.json").write_text(json.dumps({"export_categories": ["movie"], "pdf_categories": ["nature"]}))
    cli.main(["export", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--config", str(tmp_path / "c.json"), "--formats", "json", "csv", "excel", "map", "pdf"])
    assert [r["activity"] for r in spark.read.json(str(tmp_path / "out/activities.json")).collect()] == ["Film"]
    assert spark.read.csv(str(tmp_path / "out/activities.csv"), header=True).first()["activity"] == "Film"
    assert b"Beach" in (tmp_path / "out/activities.pdf").read_bytes() and b"Film" not in (tmp_path / "out/activities.pdf").read_bytes()
    assert "Film" in (tmp_path / "out/activities.html").read_text() and (tmp_path / "out/activities.xlsx").read_bytes()[:2] == b"PK"


def test_cache(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    row = "key string, data string, cached_at timestamp"
    for data, at in (("old", 1), ("new", 2)):
        cache.put(spark.createDataFrame([("k", data, datetime.datetime(2024, 1, at))], row))
    assert [r["data"] for r in cache.read().collect()] == ["new"]
    cache.clear()
    assert cache.read().count() == 0
