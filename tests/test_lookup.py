"""Keys, named things, statistics and semantic candidates on small cases."""

import hashlib
import json

from pyspark.sql import functions as F

from murmurlake.functions import keys
from murmurlake.functions import text as T
from murmurlake.functions import urls as U
from murmurlake.operators import costs, entities, previews, semantic, stats


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_canonical_json(spark):
    kind = "struct<b:array<string>,a:struct<z:double,y:long,x:boolean>,c:string>"
    texts = ['q"\\/', "\x00\x0b\x1f\n\t\x7f", "é😀", None]
    rows = spark.createDataFrame([((texts, (2.0, 7, True), None),)], f"v {kind}")
    got = rows.select(keys.canonical_json(F.col("v"), rows.schema["v"].dataType)).first()[0]
    want = {"a": {"x": True, "y": 7, "z": 2}, "b": texts}
    assert got == json.dumps(want, separators=(",", ":"), ensure_ascii=False)


def test_embedding_key_ignores_order_and_sorts_by_code_units(spark):
    inputs = ["～", "😀", "b", "Z", ""]
    ordered = sorted(inputs, key=lambda t: t.encode("utf-16-be"))
    payload = json.dumps({"inputs": ordered}, separators=(",", ":"), ensure_ascii=False)
    want = "ai/openai/m/" + hashlib.sha256(f"openai:m:{payload}".encode()).hexdigest()
    for given in (inputs, inputs[::-1]):
        assert _one(spark, keys.embedding_key(F.lit("m"), F.lit(given)))[0] == want


def test_prompt_signature():
    assert keys.prompt_signature("a", "b") != keys.prompt_signature("a", "c") and len(keys.prompt_signature("")) == 8


def test_url_problem(spark):
    cases = {
        "https://own.example/a": "blocked domain", "https://x.OWN.example": "blocked domain", "https://myown.example/a": None, "file:///etc": "invalid protocol",
        "no address": "invalid address", "https://b.org//a": "suspicious path", "HTTPS://b.org/a?x=..": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", U.url_problem(F.col("u"), ("own.example",)).alias("p"))
    assert {r.u: r.p for r in rows.collect()} == cases


def test_text_scalars(spark):
    got = _one(
        spark, T.first_url(F.lit("a HTTP://b.org/c) d")), T.first_url(F.lit("nothing")), T.parse_boolean(F.lit("True")), T.parse_boolean(F.lit("")),
        T.plain_license(F.lit(" CC BY_SA  Version 4.0 ")), U.is_reddit(F.lit("https://notreddit.com/a")), U.is_reddit_share(F.lit("https://reddit.com/r/a/s/Xy1")),
    )
    assert tuple(got) == ("HTTP://b.org/c)", None, True, None, "cc-by-sa-4.0", False, True)


def test_entities(spark):
    kind = "array<struct<key:string,covers:array<long>,physical_format:string>>"
    editions = [[("/books/A", [], None), ("/books/B", [1], "Audio CD"), ("/books/C", [7, 8], "Paperback")], [("/books/D", None, None)], [], None]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(editions)], f"i int, e {kind}")
    got = {r[0]: r[1] for r in rows.select("i", entities.edition_with_cover(F.col("e"))).collect()}
    assert tuple(got[0]) == ("C", 7, "Paperback") and got[1] is None and got[2] is None and got[3] is None
    match = _one(spark, entities.chosen_match(F.lit("t"), F.lit(["https://store.steampowered.com/app/1"])), entities.chosen_match(F.lit("t"), F.array().cast("array<string>")))
    assert tuple(match[0]) == ("https://store.steampowered.com/app/1", "steam", "t") and match[1] is None
    names = {"Beach.jpg": True, "Map.SVG": False, "City logo.png": False, "Coat_of_arms.png": False}
    told = spark.createDataFrame([(n,) for n in names], "n string").select("n", entities.is_photo_name(F.col("n")))
    assert dict(tuple(r) for r in told.collect()) == names
    empty = F.create_map().cast("map<string,string>")
    assert tuple(_one(spark, entities.is_acceptable(empty, F.lit(None), F.lit("")), entities.is_acceptable(empty, F.lit("i"), F.lit(None)))) == (False, True)


def test_previews(spark):
    links = spark.createDataFrame([(1, "https://www.a.org/x"), (2, ""), (3, None), (4, "https://b.org")], "activity_id long, link string")
    pages = spark.createDataFrame([("https://www.a.org/x", "", "page", None, "img")] * 2, "url string, canonical_url string, title string, description string, image_url string")
    things = spark.createDataFrame([(1, "thing", "about", None, "book", {"imdb": "tt1"})] * 2, "activity_id long, title string, description string, image_url string, kind string, ids map<string,string>")
    got = {r.activity_id: r for r in previews.link_previews(links, pages, things).collect()}
    assert set(got) == {1, 4}
    assert tuple(got[1])[1:] == ("https://www.a.org/x", "page", "about", "img", "a.org", "resolved", "book", {"imdb": "tt1"})
    assert tuple(got[4])[1:] == ("https://b.org", None, None, None, "b.org", "scraped", None, None)
    assert previews.link_previews(links.limit(0), pages, things.limit(0)).count() == 0


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "latitude double, longitude double, place_lookup_source string, source string, messages array<struct<sender:string>>, content string, tokens long")
    assert set(stats.places(none).first()) == {0} and set(stats.images(none).first()) == {0} and set(stats.report_header(none).first()) == {0}
    assert set(stats.to_embed(none).first()) == {0} and stats.usage_total(none, ("tokens",)).first()[0] == 0


def test_unknown_model_is_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="unknown model"):
        _one(spark, costs.embedding_cost(F.lit("nothing"), F.lit(3)))


def test_semantic_and_heuristic_candidates_merge(spark):
    said = ["we should try the new cafe", "sounds fun, i'm keen", "short", "a quiet evening at home"]
    rows = [(c, i, f"2024-01-0{i + 1}", "ann", t, []) for c in (1, 2) for i, t in enumerate(said)]
    chat = spark.createDataFrame(rows, "chat_id long, id long, at string, sender string, content string, urls array<string>").withColumn("timestamp", F.to_timestamp("at")).drop("at")
    vectors = spark.createDataFrame([(1, 3, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (2, 3, [0.0, 1.0]), (1, 99, [1.0, 0.0])], "chat_id long, message_id long, embedding array<double>")
    asked = spark.createDataFrame([("ideas", [1.0, 0.1]), ("yes", [0.0, 1.0])], "query string, embedding array<double>")
    queries = semantic.queries_of(asked.filter("query = 'ideas'"), asked.filter("query = 'yes'"), asked).withColumn("q_idx", F.when(F.col("query") == "ideas", 0).otherwise(1))
    found = semantic.semantic_candidates(chat, vectors, queries, 0.5, 1)
    assert {(r.chat_id, r.message_id, r.source_name, r.candidate_type) for r in found.collect()} == {(1, 3, "ideas", "suggestion"), (2, 3, "yes", "agreement")}
    merged = {(r.chat_id, r.message_id): r.source_type for r in semantic.all_candidates(chat, found).collect()}
    assert merged[(1, 0)] == merged[(2, 0)] == "regex" and merged[(1, 3)] == "semantic"
    assert (1, 2) not in merged and (2, 3) not in merged  # too short; a reply within a suggestion's window


def test_export_options_by_place():
    import datetime

    from murmurlake.operators.filters import ExportFilter, filter_of

    args = {"export_categories": [], "export_from": ["Ann"], "export_max_activities": 0, "export_sort": "score", "export_end_date": "2024-13-01", "pdf_sort": "score", "pdf_max_activities": 0}
    config = {
        "export_categories": ["food"], "export_from": ["Bo"], "export_max_activities": 7, "export_sort": "oldest", "export_end_date": "2024-01-01",
        "pdf_categories": ["music"], "pdf_only_locations": True, "pdf_start_date": "2024-02-03", "pdf_min_score": 0.5, "export_min_score": 0.25,
    }
    assert filter_of("csv", args) == ExportFilter(senders=("Ann",))
    assert filter_of("csv", args, config) == ExportFilter(categories=("food",), senders=("Ann",), min_score=0.25, order="oldest", limit=7)
    told = filter_of("pdf", args, config)
    assert told == ExportFilter(categories=("music",), senders=("Ann",), start=datetime.date(2024, 2, 3), min_score=0.5, only_locations=True, order="oldest", limit=7)
    assert filter_of("pdf", args, config | {"pdf_max_activities": 0}).limit is None
    assert filter_of("pdf", args | {"pdf_max_activities": 3, "pdf_categories": ["art"]}, config).limit == 3


def test_assigned_objects_end_at_their_own_brace(spark):
    from murmurlake.operators import pages, platforms

    html = 'x <script>var ytInitialPlayerResponse = {"videoDetails": {"title": "a }; var \\" {b", "author": "me"}}; var other = {"videoDetails": 1};</script>'
    rows = spark.createDataFrame([("https://youtu.be/abcdefghijk", 200, html), ("https://youtu.be/abcdefghijk", 200, "none"), (None, None, None)], "url string, status int, html string")
    told = rows.select(pages.assigned_json(F.col("html"), "ytInitialPlayerResponse").alias("j")).select(F.get_json_object("j", "$.videoDetails.title").alias("t"))
    assert [r["t"] for r in told.collect()] == ['a }; var " {b', None, None]
    assert platforms.scrape(rows.limit(1)).first()["title"] == 'a }; var " {b'


def test_pictures_of_nothing(spark):
    from murmurlake.operators import media

    rows = spark.createDataFrame([(1, None, None, None, None)], "k int, wiki_name string, place_name string, city string, country string")
    pictures = spark.createDataFrame([], "article string, rank int, name string, width int, license string, image_url string")
    made = media.article_images(rows, pictures)
    assert made.select("image_url", "image_url_source").first() == (None, None)
    assert [tuple(r) for r in media.image_stats(made).collect()] == [("none", 1)]
