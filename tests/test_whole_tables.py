"""Searches and groups over all rows of a table, against brute force."""

import itertools
import math
import os

import pytest

from murmurlake.operators import clustering, vector
from murmurlake.plans import queries

SF = "/root/testdata/sf0.001"
FIELDS = ["media_key", "place_name", "city", "region", "country", "wiki_name"]


def test_best_query_of_many_queries(spark):
    n = 10_050
    angle = "embedding array<double>"
    asked = spark.createDataFrame([(i, [math.cos(i * 1e-4), math.sin(i * 1e-4)]) for i in range(n)], f"q_idx long, {angle}").coalesce(1)
    rows = spark.createDataFrame([(i, [math.cos(q * 1e-4), math.sin(q * 1e-4)]) for i, q in enumerate((5, n - 1, n - 30, 9_000))], f"id long, {angle}")
    got = {r["id"]: r["q_idx"] for r in vector.best_query(rows, asked, 4, 0.0).collect()}
    assert got == {0: 5, 1: n - 1, 2: n - 30, 3: 9_000}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def like(a, b):
    return a == b or bool(a and b) and 1 - edits(a, b) / max(len(a), len(b)) >= 0.95


def leaders_of(rows):
    leaders, out = [], {}
    for row in sorted(rows, key=lambda r: r["ord"]):
        own = {f: (row[f] or "").lower() for f in ["activity", *FIELDS]} | {"ord": row["ord"], "link": row["link"]}
        for x in leaders:
            free = {f: not x[f] or not own[f] or x[f] == own[f] for f in FIELDS}
            venue = not x["place_name"] or not own["place_name"] or like(x["place_name"], own["place_name"])
            titled = free["city"] and free["country"] and like(x["activity"], own["activity"])
            if x["link"] == own["link"] and (titled or venue and all(v for f, v in free.items() if f != "place_name")):
                out[own["ord"]] = x["ord"]
                break
        else:
            leaders.append(own)
            out[own["ord"]] = own["ord"]
    return out


def test_leader_groups_with_empty_fields(spark):
    made = itertools.product(("Walk", "Swim"), ("Bay of plenty shore", "Hill", None, ""), ("Napier", "Nelson", None), ("NZ", None))
    rows = [(i * 37 % 48, t, None, p, c, None, land, None, ("web", "q") if i % 5 == 0 else None) for i, (t, p, c, land) in enumerate(made)]
    df = spark.createDataFrame(rows, "ord long, activity string, media_key string, place_name string, city string, region string, country string, wiki_name string, link struct<type:string,query:string>")
    assert {r["ord"]: r["leader_ord"] for r in clustering.leader_groups(df).collect()} == leaders_of(df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_leader_groups_query_holds_all_activities(spark):
    rows = queries.activities(spark, SF).collect()
    got = {r["ord"]: r["leader_ord"] for r in queries.leader_groups(spark, SF).collect()}
    assert len(got) == len(rows) and got == leaders_of(rows)
