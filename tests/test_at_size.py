"""Operators that deal one chat, or a whole table, to many tasks, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlake.functions.stored import numbered
from murmurlake.operators import clustering, context, platforms, vector
from murmurlake.sources import sinks
from test_whole_tables import FIELDS, leaders_of, like


def test_numbered_over_a_table_and_by_a_column(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.randint(0, 300), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(6)
    got = [(r["v"], r["i"], r["number"]) for r in numbered(df, [F.desc("v"), F.col("i")], start=0).collect()]
    assert sorted(got) == sorted((v, i, n) for n, (_, v, i) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2]))))
    by_key = numbered(df, [F.col("v")], by=("k",), ties=(F.col("i"),), drop=("v",)).collect()
    want = set()
    for k in {r[0] for r in rows}:
        want |= {(k, i, n) for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1)}
    assert {(r["k"], r["i"], r["number"]) for r in by_key} == want
    assert numbered(df.limit(0), [F.col("v")]).count() == numbered(df.limit(0), [F.col("v")], by=("k",)).count() == 0


def test_numbers_of_exports_come_from_many_tasks(spark):
    rows = spark.range(5000).selectExpr(
        "5000 - id AS ord", "'a' AS activity", "'food' AS category", "1.0D AS score", "array(named_struct('timestamp', timestamp'2024-01-01', 'sender', concat('s', id % 7), 'message', 'm')) AS messages",
        "'p' AS place_name", "'c' AS city", "'l' AS country", "1.0D AS latitude", "2.0D AS longitude", "'x' AS place_id", "'url' AS place_lookup_source",
    )
    made = sinks.csv_rows(rows)
    assert [r["id"] for r in made.select("id").orderBy("id").collect()] == list(range(1, 5001))
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    shown = sinks.map_rows(rows)
    assert "SinglePartition" not in shown._jdf.queryExecution().executedPlan().toString()
    assert shown.select("sender", "colour").distinct().count() == 7


def bounds(lengths, messages, chars):
    out = []
    for i in range(len(lengths)):
        a = i
        while a > 0 and (i - a < messages or sum(lengths[a:i]) < chars):
            a -= 1
        b = i
        while b < len(lengths) - 1 and (b - i < messages or sum(lengths[i + 1 : b + 1]) < chars):
            b += 1
        out.append((i, a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_context_bounds_across_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(context, "BLOCK", 4)
    monkeypatch.setattr(context, "REACH", 16)
    rng = random.Random(seed)
    chats = {c: [rng.choice([0, 0, 1, 3, 9, 40, 200]) for _ in range(rng.choice([1, 2, 60]))] for c in "abcd"} | {"e": [0] * 30}
    rows = [(c, i, "x" * n if n else rng.choice([None, ""]), 1) for c, ns in chats.items() for i, n in enumerate(ns)]
    got = context.context_bounds(spark.createDataFrame(rows, "chat_id string, id long, content string, other int"), 2, 13).collect()
    assert sorted((r["chat_id"], r["id"], r["first_id"], r["last_id"]) for r in got) == sorted((c, *b) for c, ns in chats.items() for b in bounds(ns, 2, 13))


def test_gaps_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(context, "BLOCK", 7)
    rng = random.Random(3)
    chats = {c: sorted(rng.sample(range(400), n)) for c, n in (("a", 90), ("b", 3), ("c", 1))}
    rows = [(c, i, "x") for c, ids in chats.items() for i in ids] + [("a", chats["a"][10], "twice")]
    want = []
    for c, ids in chats.items():
        group, last = 0, None
        for i in ids:
            group, last = group + (last is None or i - last > 5), i
            want += [(c, i, group)] * (2 if c == "a" and i == ids[10] else 1)
    got = context.proximity_groups(spark.createDataFrame(rows, "chat_id string, message_id long, other string")).collect()
    assert sorted((r["chat_id"], r["message_id"], r["group_no"]) for r in got) == sorted(want)


def fold(groups, size):
    batch, used, out = -1, size, []
    for group, held in groups:
        whole = -(-held // size)
        if held <= size and used + held <= size:
            used += held
            out.append((group, batch))
        else:
            out.append((group, batch + 1))
            batch, used = (batch + whole, size) if held > size else (batch + 1, held)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_smart_batches_are_those_of_a_fold(spark, monkeypatch, seed):
    monkeypatch.setattr(context, "BLOCK", 8)
    monkeypatch.setattr(context, "REACH", 12)
    rng = random.Random(seed)
    chats = {c: [(g, rng.choice([1, 1, 2, 3, 4, 5, 6, 9, 17])) for g in sorted(rng.sample(range(1, 400), n))] for c, n in (("a", 1), ("b", 2), ("c", 150))}
    rows = [(c, g) for c, groups in chats.items() for g, held in groups for _ in range(held)]
    got = context.smart_batches(spark.createDataFrame(rows, "chat_id string, group_no long"), 5).collect()
    assert sorted(map(tuple, got)) == sorted((c, g, b) for c, groups in chats.items() for g, b in fold(groups, 5))


def test_similar_texts_are_all_pairs(spark):
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (18, 19, 20, 21, 39, 40, 61, 120)]
    texts = set()
    for base in bases:
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            texts.add("".join(t))
    got = clustering.similar_texts(spark.createDataFrame([(t,) for t in texts] * 2, "text string")).collect()
    want = {(a, b) for a in texts for b in texts if a != b and like(a, b)}
    assert len(want) > 50 and len(got) == len(want) and {tuple(r) for r in got} == want


def test_leader_groups_of_long_titles_and_chains(spark):
    rng = random.Random(6)
    title, place = "walk along the shore of the bay at low tide", "the old lighthouse on the hill"
    rows = []
    for i in range(160):
        t, p = list(title), list(place)
        for s in (t, p):
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                s[rng.randrange(len(s))] = rng.choice("xyz")
        rows.append((i * 31 % 160, "".join(t), rng.choice(["m", None]), rng.choice(["".join(p), None, ""]), rng.choice(["Napier", "Nelson", None]), rng.choice(["r", None]), rng.choice(["NZ", None]), None, None))
    # Each step is like the one before only: followers don't lead on.
    chain = [title]
    for i in range(0, 24, 2):
        chain.append(chain[-1][:i] + "##" + chain[-1][i + 2 :])
    rows += [(1000 + i, t, "k", f"place {i}", "Bluff", None, "AU", f"w{i}", ("web", "c")) for i, t in enumerate(chain)]
    kinds = "ord long, activity string, " + ", ".join(f"{f} string" for f in FIELDS) + ", link struct<type:string,query:string>"
    df = spark.createDataFrame(rows, kinds)
    got = {r["ord"]: r["leader_ord"] for r in clustering.leader_groups(df).collect()}
    assert got == leaders_of(df.collect())
    assert len({got[1000 + i] for i in range(len(chain))}) > 3
    assert clustering.leader_groups(df.limit(0)).count() == 0


def test_best_query_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(vector, "BLOCK_BYTES", 400)
    monkeypatch.setattr(vector, "ROWS_AT_ONCE", 7)
    rows = [(i % 2, i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)] + [(0, 200, [0.0] * 4), (1, 201, [1.0] * 3), (1, 202, None), (0, 203, [])]
    rows.append((0, 204, rows[0][2]))
    asked = [(q, [rng.gauss(0, 1) for _ in range(4)]) for q in range(25)] + [(50, [0.0] * 4), (51, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "chat int, id long, embedding array<float>").repartition(3)
    df = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = vector.best_query(df, spark.createDataFrame(asked, "q_idx int, embedding array<double>"), 3, 0.0, within=("chat",)).collect()

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    held = {r["id"]: r["embedding"] for r in df.collect()}
    best = {}
    for chat in (0, 1):
        for q, e in asked:
            scored = sorted(((-cosine(held[i], e), i) for c, i, _ in rows if c == chat and held[i] and len(held[i]) == len(e) and cosine(held[i], e) >= 0))
            for s, i in scored[:3]:
                best[(chat, i)] = max(best.get((chat, i), (-1, 0)), (-s, -q))
    assert {(r["chat"], r["id"]): r["q_idx"] for r in found} == {k: -q for k, (_, q) in best.items()}
    assert all(abs(r["similarity"] - best[(r["chat"], r["id"])][0]) < 1e-12 for r in found)


def test_redirects_tell_long_chains_from_cycles(spark):
    steps = {f"a{i}": f"a{i + 1}" for i in range(40)} | {"b0": "b1", "b1": "b2", "b2": "b0", "c": "c"} | {f"d{i}": f"d{i + 1}" for i in range(10)} | {"in": "b1"}
    rows = [(k, v) for k, v in steps.items()] + [("a0", "z")]
    urls = [*steps, "a40", "nothing", "a0"]
    got = platforms.follow_redirects(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rows, "url string, target string")).collect()

    def walk(url, most=10):
        at, seen, hops = url, {url}, 0
        while at in steps:
            at, hops = steps[at], hops + 1
            if at in seen:
                hops = None
                break
            seen.add(at)
        place = url
        for _ in range(most):
            place = steps.get(place, place)
        return url, place, hops, "cycle" if hops is None else "too_many" if hops > most else "final"

    assert sorted(map(tuple, got), key=repr) == sorted(map(walk, urls), key=repr)
    none = platforms.follow_redirects(spark.createDataFrame([("x",)], "url string"), spark.createDataFrame([], "url string, target string"))
    assert [tuple(r) for r in none.collect()] == [("x", "x", 0, "final")]


@pytest.mark.parametrize("block", [4, 4096])
def test_gaps_and_batches_keep_rows_without_chat_or_id(spark, monkeypatch, block):
    monkeypatch.setattr(context, "BLOCK", block)
    rows = [(1, 1), (1, 3), (1, 20), (1, None), (None, 2), (None, 40), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "chat_id long, message_id long")
    grouped = context.proximity_groups(df)
    want = {(1, 1, 1), (1, 3, 1), (1, 20, 2), (1, None, 3), (None, 2, 1), (None, 40, 2), (None, None, 3), (2, None, 1)}
    assert sorted(map(str, map(tuple, grouped.collect()))) == sorted(map(str, want))
    assert {tuple(r) for r in context.smart_batches(grouped, 2).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0)}


@pytest.mark.parametrize("whole", [4096, 5])
def test_best_query_within_chats_leaves_a_row_for_a_vector(spark, monkeypatch, whole):
    monkeypatch.setattr(vector, "WHOLE", whole)
    monkeypatch.setattr(vector, "HELD", 64)
    rng = random.Random(5)
    sizes = {None: 3, 1: 1, 2: 9, 3: 70, **{c: 4 for c in range(4, 40)}}
    rows = [(c, i, [float(rng.randint(-3, 3)) for _ in range(3)]) for c, n in sizes.items() for i in range(n)]
    asked = [(q, [float(rng.randint(-3, 3)) for _ in range(3)]) for q in range(60)]
    df = spark.createDataFrame(rows, "chat long, id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "q_idx long, embedding array<double>")

    def alike(x, y):
        norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
        return 0.0 if norm == 0 else sum(a * b for a, b in zip(x, y, strict=True)) / norm

    want = {}
    for c in sizes:
        for q, y in asked:
            met = sorted((-alike(x, y), i) for chat, i, x in rows if chat == c and alike(x, y) >= 0.1)
            for s, i in met[:2]:
                want[c, i] = min(want.get((c, i), (2.0, 0)), (s, q))
    got = vector.best_query(df, queries, 2, 0.1, within=("chat",)).collect()
    assert {(r["chat"], r["id"]): (-r["similarity"], r["q_idx"]) for r in got} == want and len(got) == len(want)
    matrix = np.array([y for _, y in asked])
    told = vector._best_of_groups(df, [q for q, _ in asked], matrix, 2, 0.1, ("chat",))
    assert told.count() == len(want)  # pairs of vectors and queries stay in their task
