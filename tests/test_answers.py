"""Provider fallback and entity resolution on small cases."""

import pytest

from pyspark.sql import functions as F

from murmurlake.functions.text import event_date, without_accents
from murmurlake.operators import classify, clustering, enrich, prompts, providers, resolve

ANSWERS = "provider string, request_id string, text string, error_type string, message string, input_tokens long, output_tokens long"


def test_only_rate_limits_go_on(spark):
    rows = [
        ("a", "1", "yes", None, None, 5, 6), ("b", "1", "never asked", None, None, 1, 1),
        ("a", "2", None, "rate_limit", "slow", None, None), ("b", "2", "second", None, None, 7, 8),
        ("a", "3", None, "auth", "no key", None, None), ("b", "3", "never asked", None, None, 1, 1),
        ("a", "4", None, "rate_limit", "slow", None, None), ("b", "4", None, "rate_limit", "slower", None, None),
        ("a", "6", None, "rate_limit", "slow", None, None), ("a", "6", "of two answers the text", None, None, 1, 2),
        ("a", "7", "paid for", None, None, 9, 9), ("a", "nobody's", "x", None, None, 1, 1),
    ]
    requests = spark.createDataFrame([(str(i),) for i in (1, 2, 3, 4, 5, 6, 7, 7)], "request_id string")
    cached = spark.createDataFrame([("7", "kept"), ("1", None)], "request_id string, text string")
    made = providers.answered(requests, spark.createDataFrame(rows, ANSWERS), ("a", "b"), cached)
    got = {r["request_id"]: (r["provider"], r["text"], r["error_type"], r["message"], r["input_tokens"], r["tried"]) for r in made.collect()}
    assert made.count() == 7 and got == {
        "1": ("a", "yes", None, None, 5, 1),
        "2": ("b", "second", None, None, 7, 2),
        "3": ("a", None, "auth", "no key", 0, 1),
        "4": ("b", None, "rate_limit", "All providers rate limited (primary and fallbacks)", 0, 2),
        "5": ("a", None, "network", "no answer", 0, 1),
        "6": ("a", "of two answers the text", None, None, 1, 1),
        "7": ("cache", "kept", None, None, 0, 0),
    }
    alone = providers.answered(requests.limit(0).union(spark.createDataFrame([("4",)], "request_id string")), spark.createDataFrame(rows, ANSWERS), ("a",))
    assert alone.first()["message"] == "slow"


@pytest.fixture
def tables(spark):
    base = spark.createDataFrame(
        [("Alien", "movie", "Q1", "Alien", 80, {"imdb": "tt1"}, None, None), ("Alien", "movie", "Q2", "Alien", 100, {}, "i", None), ("Bare", "movie", "Q3", "Bare", 9, {"other": "x"}, "", None)],
        "query string, type string, qid string, label string, sitelinks int, ids map<string,string>, image_url string, wikipedia_url string",
    )
    books = spark.createDataFrame(
        [("Dune: a novel", "Frank Herbert", "OL1", 2, "c"), ("Dune", "Somebody Else", "OL2", 1, "c"), ("Emma", "Jane Austen", "OL3", 1, None)],
        "title string, author string, work_id string, rank int, cover_url string",
    )
    hits = spark.createDataFrame(
        [("4", 1, "Heat (1995)", "https://www.imdb.com/title/tt4"), ("4", 2, "Heat", "https://x.example"), ("5", 1, "Blur", "https://www.imdb.com/title/tt5"), ("5", 2, "Blur", "https://www.imdb.com/title/tt6"),
         ("5", 3, "no", "https://www.goodreads.com/book/show/7"), ("6", 1, "else", "https://z.example"), ("3", 1, "Emma", "https://amazon.com/e")],
        "item_id string, rank int, title string, url string",
    )
    rankings = spark.createDataFrame([("5", [0, 9, 3, 1]), ("6", [7]), ("1", [1])], "item_id string, indexes array<int>")
    return base, books, hits, rankings


def test_every_item_is_found_or_failed_once(spark, tables):
    items = [("1", "Alien", "movie", None), ("2", "Dune", "book", "Frank Herbert & Son"), ("2b", "Dune", "book", None), ("3", "Emma", "book", "Jane Austen"), ("4", "Heat", "movie", None), ("5", "Blur", "movie", None), ("6", "Zed", "movie", None), ("7", "Bare", "movie", None)]
    df = spark.createDataFrame(items, "item_id string, query string, type string, author string")
    made = resolve.resolve(df, *tables)
    got = {r["item_id"]: (r["stage"], r["source"], r["url"]) for r in made.collect()}
    assert made.count() == len(items) and got == {
        "1": ("items", "wikidata", "https://www.imdb.com/title/tt1/"),
        "2": ("books", "openlibrary", "https://openlibrary.org/works/OL1"),
        "2b": ("books", "openlibrary", "https://openlibrary.org/works/OL2"),
        "3": ("heuristic", "heuristic", "https://amazon.com/e"),
        "4": ("heuristic", "heuristic", "https://www.imdb.com/title/tt4"),
        "5": ("ranking", "heuristic", "https://www.goodreads.com/book/show/7"),
        "6": ("deferred", None, None),
        "7": ("search", None, None),
    }
    assert {r["item_id"] for r in resolve.deferred(df, tables[2]).collect()} == {"5", "6"}
    assert resolve.resolve(df.limit(0), *tables).count() == 0


def test_responses_that_give_nothing(spark):
    rows = [
        ("ok", [1], '[{"msg": 1, "title": "a"}]'), ("none", [1], "I found nothing"), ("empty", [1], "```json\n[]\n```"), ("other", [1], '[{"msg": 2}, {"msg": "x"}]'),
        ("broken", [1], '[{"msg": 1, "title": "a]'), ("both", [1, 2], '[{"msg": 7}, {"msg": "2"}]'), ("null", [1], None),
    ]
    df = spark.createDataFrame(rows, "batch_id string, expected_ids array<long>, response string")
    assert {tuple(r) for r in classify.failed_batches(df).collect()} == {("none", "no_json"), ("null", "no_json"), ("other", "no_expected_id"), ("broken", "bad_json")}


def test_small_rules(spark):
    words = ["Tiếng Việt", "México", "ŁÓDŹ", "Ångström", "naïve café", "日本", "e\u0301", "plain"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(without_accents(F.col("w"))).collect()
    assert [r[0] for r in got] == ["Tieng Viet", "Mexico", "ŁODZ", "Angstrom", "naive cafe", "日本", "e", "plain"]
    one = spark.range(1)
    assert one.select(event_date(F.lit("2024-03-05 01:00:00").cast("timestamp"))).first()[0] == "Mar 5"
    licenses = [F.array(F.lit("fair use"), F.lit("CC0")), F.array(F.lit("fair use")), F.array().cast("array<string>")]
    assert list(one.select(*[enrich.any_license_allowed(x) for x in licenses]).first()) == [True, False, False]
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], "ord long, messages array<string>")
    assert [r["ord"] for r in clustering.mentioned_at_least(rows, 2).collect()] == [2]
    kinds = spark.createDataFrame([("a", "agreement"), ("s", "suggestion"), ("n", None)], "k string, candidate_type string")
    suggestions, agreements = prompts.by_kind(kinds)
    assert {r["k"] for r in suggestions.collect()} == {"s", "n"} and [r["k"] for r in agreements.collect()] == ["a"]
    with pytest.raises(ValueError):
        prompts.user_context("")


def test_cascade_sends_no_table_through_the_driver(spark):
    from murmurlake.operators import resolve

    items = spark.createDataFrame([(1, "a b", "book", "x"), (2, "c", "movie", None)], "item_id long, query string, type string, author string")
    base = spark.createDataFrame([("c", "movie", "Q1", "c", 3, {"imdb": "tt1"}, None, None)], "query string, type string, qid string, label string, sitelinks int, ids map<string,string>, image_url string, wikipedia_url string")
    books = spark.createDataFrame([("a b: c", "x", "OL1", 1, "u")], "title string, author string, work_id string, rank int, cover_url string")
    hits = spark.createDataFrame([(1, 1, "a b", "https://www.goodreads.com/book/show/1")], "item_id long, rank int, title string, url string")
    rankings = spark.createDataFrame([(1, [1])], "item_id long, indexes array<int>")
    made = [resolve.from_items(items, base), resolve.from_books(items, books), resolve.from_hits(items, hits), resolve.from_rankings(items, hits, rankings)]
    told = resolve.resolve(items, base, books, hits, rankings)
    assert {(r["item_id"], r["stage"]) for r in told.collect()} == {(1, "books"), (2, "items")}
    for df in [*made, told, resolve.deferred(items, hits)]:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
