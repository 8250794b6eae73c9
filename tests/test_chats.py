"""Parsing, windows, candidates, groups: small rows and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.functions import urls as U
from murmurlake.operators import candidates, classify, clustering, context, costs, enrich, filters, pages
from murmurlake.operators import patterns as P
from murmurlake.sources import chat, sinks

IOS = (
    "text before\r\n‎[1/2/24, 9:05:07 PM] Ann: we should go to the beach\nsecond line\n[1/2/24, 9:06:00 PM] Bob: ‎image omitted\n"
    "[1/2/24, 9:07:00 PM] Bob: You deleted this message\n[1/3/24, 12:00:00 AM] Ann: see https://youtu.be/abcdefghijk. ok: yes"
)
ANDROID = "13/45/24, 10:00 - Ann: bad date\n1/2/24, 23:59 - Ann: it’s fine"
APPLE = "Jan 02, 2024  8:05:09 AM (Read by you)\nAnn\n\nhello there\nagain\n\nJan 03, 2024 9:00:00 PM\nBob\nlet's go"


def parsed(spark, **texts):
    rows = chat.parse_chats(spark.createDataFrame(list(texts.items()), "chat_id string, content string")).orderBy("chat_id", "id").collect()
    return {k: [r for r in rows if r["chat_id"] == k] for k in texts}


def test_parse_formats(spark):
    got = parsed(spark, ios=IOS, android=ANDROID, apple=APPLE, empty="")
    assert [r["content"] for r in got["ios"]] == ["we should go to the beach\nsecond line", "‎image omitted", "see https://youtu.be/abcdefghijk. ok: yes"]
    assert [r["id"] for r in got["ios"]] == [0, 1, 2]
    assert str(got["ios"][0]["timestamp"]) == "2024-01-02 21:05:07" and str(got["ios"][2]["timestamp"]) == "2024-01-03 00:00:00"
    assert got["ios"][1]["media_type"] == "image" and got["ios"][2]["urls"] == ["https://youtu.be/abcdefghijk"]
    assert [(r["sender"], r["content"], r["timestamp"] is None) for r in got["android"]] == [("Ann", "bad date", True), ("Ann", "it's fine", False)]
    assert [(r["sender"], r["content"]) for r in got["apple"]] == [("Ann", "hello there\nagain"), ("Bob", "let's go")]
    assert got["empty"] == []


def test_chunks_rejoin():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab  c") for _ in range(rng.randint(0, 900))).strip()
        pieces = chat.split_text(text)
        assert pieces == [text] if len(text) <= 280 else all(len(p) <= 280 + chat.MIN_CHUNK for p in pieces)
        assert "".join(p.strip("…") for p in pieces).replace(" ", "") == text.replace(" ", "")


def brute_bounds(sizes):
    out = []
    for i in range(len(sizes)):
        a = i
        while a > 0 and (i - a < 2 or sum(sizes[a:i]) < 280):
            a -= 1
        b = i
        while b < len(sizes) - 1 and (b - i < 2 or sum(sizes[i + 1 : b + 1]) < 280):
            b += 1
        out.append((a, b))
    return out


def test_context_bounds(spark):
    rng = random.Random(2)
    chats = {c: [rng.choice([0, 3, 50, 279, 280, 281, 600]) for _ in range(n)] for c, n in (("a", 1), ("b", 40), ("c", 90))}
    rows = [(c, i, "x" * n) for c, ns in chats.items() for i, n in enumerate(ns)]
    got = context.context_bounds(spark.createDataFrame(rows, "chat_id string, id long, content string")).collect()
    for c, ns in chats.items():
        mine = {r["id"]: (r["first_id"], r["last_id"]) for r in got if r["chat_id"] == c}
        assert [mine[i] for i in range(len(ns))] == brute_bounds(ns)


def test_agreements_go_within_windows(spark):
    messages = [("a", i, "x" * 100, "s", None) for i in range(40)]
    m = spark.createDataFrame(messages, "chat_id string, id long, content string, sender string, timestamp timestamp")
    found = [("a", 10, "suggestion", 0.9), ("a", 12, "agreement", 0.5), ("a", 14, "agreement", 0.5), ("b", 12, "agreement", 0.5)]
    c = spark.createDataFrame(found, "chat_id string, message_id long, candidate_type string, confidence double")
    kept = candidates.drop_agreements(c, context.context_bounds(m.select("chat_id", "id", "content"))).collect()
    assert {(r["chat_id"], r["message_id"]) for r in kept} == {("a", 10), ("a", 14), ("b", 12)}


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("we should go", "we_should"),
        ("We should not go", None),
        ("let's go home", None),
        ("lets go there", "lets_go"),
        ("bucket list, we should", "bucket_list"),
        ("can we please go", "can_we"),
        ("sounds fun", "looks_fun"),
        ("caféwe should", "we_should"),
        ("dentist: we should go", "we_should"),
        ("", None),
    ],
)
def test_rules(spark, text, name):
    row = spark.createDataFrame([(text,)], "content string").select(P.first_pattern(F.col("content"))["pattern"].alias("p")).first()
    assert row["p"] == name


def test_urls(spark):
    url = F.lit
    got = spark.range(1).select(
        U.url_kind(url("https://netflix.com")).alias("a"),
        U.url_kind(url("https://facebook.com/events/1")).alias("b"),
        U.maps_coordinates(url("https://maps.google.com/?q=-1.5,2")).alias("c"),
        U.spotify_id(url("https://open.spotify.com/track/Ab1")).alias("d"),
        U.domain(url("not an address")).alias("e"),
        P.includes_url(url("https://youtu.be/x"), url("this place")).alias("f"),
        P.best_url(F.array(url("https://x.org"), url("https://airbnb.com/rooms/1"), url("https://booking.com/2")))["kind"].alias("g"),
    ).first()
    assert (got["a"], got["b"], got["c"]["lat"], got["d"], got["e"], got["f"], got["g"]) == ("x", "event", -1.5, "Ab1", None, False, "airbnb")


def test_smart_batches(spark):
    rows = [("a", g, i) for g, n in ((1, 2), (2, 3), (3, 9), (4, 1)) for i in range(n)]
    got = context.smart_batches(spark.createDataFrame(rows, "chat_id string, group_no long, message_id long"), 4).collect()
    assert {r["group_no"]: r["batch_no"] for r in got} == {1: 0, 2: 1, 3: 2, 4: 5}


def test_leader_groups_are_not_transitive(spark):
    base = "abcdefghijklmnopqrstuvwxyzabcdefghijklmn"
    titles = [base, base[:-2] + "zz", base[:-4] + "zzzz"]
    rows = [(i, t, None, "p%d" % i, "c", None, "nz", None, None) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "ord long, activity string, media_key string, place_name string, city string, region string, country string, wiki_name string, link struct<type:string,query:string>")
    assert {r["ord"]: r["leader_ord"] for r in clustering.leader_groups(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_filters_reject_both_only_flags(spark):
    with pytest.raises(ValueError):
        filters.select_activities(spark.range(1), filters.ExportFilter(only_locations=True, only_generic=True))


def test_license_and_offsets(spark):
    got = spark.range(1).select(
        enrich.license_check(F.lit("CC BY-NC 4.0"))["allowed"].alias("a"),
        enrich.license_check(F.lit("cc-by-sa-3.0"))["allowed"].alias("b"),
        enrich.license_check(F.lit(None).cast("string"))["reason"].alias("c"),
        classify.at_offset(F.lit(-1), F.lit("own"), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z"))).alias("d"),
        classify.at_offset(F.lit(3), F.lit("own"), F.array(F.lit("x")), F.array(F.lit("z"))).alias("e"),
        T.similarity(F.lit("Abc  d"), F.lit("abc d")).alias("f"),
        T.round_half_up(F.lit(1.005), 2).alias("g"),
        costs.format_micros(F.lit(1_500.0)).alias("h"),
        pages.open_graph(F.lit('<meta property="og:a" content="1"><meta content="2" property="og:a">'))["a"].alias("i"),
    ).first()
    assert tuple(got) == (False, True, "blocked", "y", None, 1.0, 1.0, "$0.0015", "2")


def test_sinks(spark, tmp_path):
    import json
    import zipfile

    message = "array<struct<id:long,timestamp:timestamp,sender:string,message:string>>"
    df = spark.createDataFrame(
        [(0, 'Say "hi", all', "food", 4.5, "P", None, "NZ", 1.5, 2.5, "id", "url", [(1, None, "Ann", "a\nb")])],
        f"ord long, activity string, category string, score double, place_name string, city string, country string, latitude double, longitude double, place_id string, place_lookup_source string, messages {message}",
    )
    sinks.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert '"Say ""hi"", all"' in text and "a b" in text
    assert json.loads(sinks.json_document(df, "x", 3))["metadata"]["geocodedCount"] == 1
    assert "points=" in sinks.map_html(df, "t")
    import io

    assert "xl/workbook.xml" in zipfile.ZipFile(io.BytesIO(sinks.xlsx_bytes(df))).namelist()


def test_references_of_every_kind(spark):
    rows = [("caf&#233; &#x27;x&#x27; &amp;amp;amp;amp;lt; &apos;&quot;", "café 'x' < '\""), ("no refs 😀 &nothing;", "no refs 😀 &nothing;"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "raw string, want string").select(T.decode_entities(F.col("raw")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_activity_ids_tell_texts_apart(spark):
    df = spark.createDataFrame([("Route 2", 3.0), ("Route 2.0", 3.0), ("Route 2", 3.5)], "t string, n double")
    ids = [r[0] for r in df.select(T.activity_id(F.col("t"), T.number_text(F.col("n")))).collect()]
    assert len(set(ids)) == 3
    assert [r[0] for r in df.select(T.number_text(F.col("n"))).collect()] == ["3", "3", "3.5"]


def test_context_bounds_of_a_long_chat(spark):
    """A chat of 200,000 messages takes time in proportion; bounds as by counting on."""
    rows = spark.range(200_000).select(F.lit("c").alias("chat_id"), "id", F.expr("repeat('x', cast(id % 97 as int))").alias("content"))
    got = context.context_bounds(rows).filter("id % 50000 = 777").orderBy("id").collect()
    for r in got:
        i, low, high, a, b = r["id"], 0, 0, r["id"], r["id"]
        while a > 0 and (low < 280 or i - a < 2):
            a -= 1
            low += a % 97
        while b < 199_999 and (high < 280 or b - i < 2):
            b += 1
            high += b % 97
        assert (r["first_id"], r["last_id"]) == (a, b)


def test_addresses_within_longer_ones(spark):
    from murmurlake.operators import platforms

    rows = spark.createDataFrame([(1, "see http://a.b/x, http://a.b/x/y and http://a.b/x.html http://a.b/x", ["http://a.b/x", "http://a.b/x/y", "http://a.b/x"])], "row_id long, content string, urls array<string>")
    known = spark.createDataFrame([("http://a.b/x", "Cost $5 \\ more"), ("http://a.b/x/y", "Y")], "url string, title string")
    assert platforms.with_url_metadata(rows, known).first()["told"] == "see http://a.b/x [Cost $5 \\ more], http://a.b/x/y [Y] and http://a.b/x.html http://a.b/x [Cost $5 \\ more]"


def test_system_lines_and_link_types(spark):
    lines = spark.createDataFrame([("  You deleted this message \n",), ("hello",)], "t string")
    assert [r[0] for r in lines.select(chat.is_system(F.col("t"))).collect()] == [True, False]
    reply = '[{"msg": 1, "title": "a", "link": {"type": "movie", "query": "q"}}, {"msg": 1, "title": "b", "link": {"type": "spaceship", "query": "q"}}]'
    got = classify.parse_responses(spark.createDataFrame([(1, [1], reply)], "batch_id long, expected_ids array<long>, response string")).collect()
    assert {r["title"]: r["link"] is not None for r in got} == {"a": True, "b": False}
