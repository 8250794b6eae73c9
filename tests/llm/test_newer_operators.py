"""The prefix trie, importance resampling and MinHash on edge cases and against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from murmurlake.llm import minhash, ngram_join, prefix_trie, queries, resample, set_groups, shingling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


# ---- prefix trie ----


def trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = original.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)).encode()).hexdigest())
        for k, m in nodes.items()
    )


def built(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.prefix_trie(df).collect())


def conversations(spark, rows):
    extra = "pos string, rep string, w string, depth string, node string, number string, _h string"
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], f"conv_id long, turn long, role string, text string, {extra}")


def test_trie_of_edge_cases(spark):
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{rng.randint(0, 1)}") for c in range(-12, 60) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160, 5) for t in range(30)]  # one long sequence, several times
    rows += [(200, None, None, None), (200, None, "user", None), (200, 0, "", "é"), (200, 0, "", "é"), (200, -1, "user", "before")]
    rows += [(None, 0, "user", "nobody's"), (206, 5, "user", "no family"), (2**40, 1, "user", "x" * 5000)]
    rng.shuffle(rows)
    assert built(conversations(spark, rows)) == trie(rows)


def test_trie_of_equal_conversations_and_none(spark):
    rows = [(c, t, "user", str(t)) for c in (5, 10, 15) for t in range(3)]
    assert built(conversations(spark, rows)) == trie(rows)
    alone = [(1, 0, "user", "all of it is its family's")]  # turnless where h > 0
    assert built(conversations(spark, alone)) == trie(alone)
    assert built(conversations(spark, rows).limit(0)) == []


def test_turns_of_a_conversation_lie_in_many_ranges(spark):
    df = spark.range(40_000).selectExpr("7L AS conv_id", "40000 - id AS turn", "'u' AS role", "cast(id AS string) AS text").repartition(8)
    got = prefix_trie.original_turns(df.unionByName(df.limit(3).selectExpr("8L AS conv_id", "turn", "role", "text")))
    assert got.filter("conv_id = 7").selectExpr("count(*)", "min(pos)", "max(pos)", "count(DISTINCT pos)").first() == (40_000, 1, 40_000, 40_000)
    assert [r[0] for r in got.filter("conv_id = 8").select("pos").orderBy("pos").collect()] == [1, 2, 3]


def test_members_of_a_bundle_run_through_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 50)
    bundles = spark.range(1000).selectExpr("id AS conv_id", "id % 3 AS rep", "300L AS w")
    want = {r: hashlib.sha256(",".join(str(c) for c in range(r, 1000, 3)).encode()).hexdigest() for r in range(3)}
    assert {r["rep"]: r["ends_sha256"] for r in prefix_trie.member_hashes(bundles).collect()} == want


# ---- importance resampling ----


def resampled(docs, target, longest):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall

    def told(text):
        w = find((text or "").translate(LOWER))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    rows = [(i, *told(t)) for i, t in docs]
    s, t = collections.Counter(b for r in rows for b in r[1]), collections.Counter(b for x in target for b in told(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    made = []
    for i, found, n in rows:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        made.append(((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))), n))
    able = sorted((r for r, n in made if n >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = collections.defaultdict(list)
    for place, r in enumerate(able, 1):
        drawn[r].append(place if place <= 10 * len(able) // 100 else None)
    return sorted(((*r, drawn[r].pop(0) if n >= 20 else None) for r, n in made), key=repr)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_resample(spark, monkeypatch, longest):
    monkeypatch.setattr(resample, "BLOCK_BYTES", 3000)
    rng = random.Random(longest)
    docs = [(i, " ".join(rng.choice("alpha Beta gamma-delta é 漢字 x1 ÉTÉ".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "!? \n"), (None, "one two " * 30), (5, docs[5][1]), (5, "other words " * 40), (203, "a b " * 20_000), (204, "W" * 9000)]
    target = ["alpha1 beta2 é3", None, "", "漢字4 漢字4 漢字5"]
    df = spark.createDataFrame([(*d, "x", "x", 1, 2) for d in docs], "doc_id long, text string, rank string, score string, weight int, n_words int").repartition(3)
    got = resample.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), longest)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, target, longest)
    nobody = resample.resample(df.limit(0), spark.createDataFrame([], "text string"), longest)
    assert nobody.count() == 0
    assert resample.resample(df, spark.createDataFrame([], "text string"), longest).count() == len(docs)


def test_suffix_array_sorts_and_tells_common_prefixes():
    rng = random.Random(1)
    counts = [0, 7, 1, 30, 2]
    ids = np.array([rng.randint(0, 2) for _ in range(sum(counts))])
    docs = np.split(ids, np.cumsum(counts)[:-1])
    left = np.concatenate([np.arange(n, 0, -1) for n in counts])
    suffixes = [tuple(d[i : i + 3].tolist()) for d in docs for i in range(len(d))]
    order, lcp = resample.suffix_array(ids, left, 3)
    ordered = [suffixes[i] for i in order]
    assert ordered == sorted(suffixes)
    assert lcp[1:].tolist() == [len(os.path.commonprefix([a, b])) for a, b in zip(ordered, ordered[1:])]


# ---- MinHash ----


def components(docs, words, times):
    find = re.compile("[^\x20\x09-\x0d]+").findall
    sets = []
    for _, t in docs:
        w = find((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= times * len(a | b):
                root[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[top(i)].append(d)
    made = []
    for i, (d, _) in enumerate(docs):
        ids = [x for x in least[top(i)] if x is not None]
        c = (min(ids) if ids else None) if sets[i] else d
        made.append((d, len(sets[i]), c, d == c))
    return sorted(made, key=repr)


def many_copies(rng, n):
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9999)}"
        out.append(" ".join(w[: rng.randint(90, 120)]))
    return out


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


@pytest.mark.parametrize("small", [None, 6])
def test_minhash_against_all_pairs(spark, monkeypatch, small):
    if small:  # crowds go through several levels of groups
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(set_groups, "SMALL", small)
        monkeypatch.setattr(set_groups, "SMALL_IN_GROUP", small)
    rng = random.Random(11)
    texts = many_copies(rng, 130) + many_copies(rng, 8)
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(120)]  # small sets
    texts += [None, "", " \n\t", "One", "one", "x " * 5000, texts[0].upper()]
    docs = list(enumerate(texts)) + [(3, texts[3]), (3, "another text of the same id"), (None, texts[7]), (None, "nobody else has these words here")]
    df = spark.createDataFrame([(*d, "k", "k", 1, 1) for d in docs], "doc_id long, text string, key string, row string, cls int, kept int").repartition(5)
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)
    want = components(docs, 4, 80)
    # A row without an id whose component has none is its own.
    assert got == sorted([(*r[:3], True) if r[0] is None and r[2] is None else r for r in want], key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketches_fill_and_agree_as_sets_do():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 800):
        shared = rng.integers(0, 2**63, 4 * size, dtype=np.uint64)
        own = rng.integers(0, 2**63, (2, size), dtype=np.uint64)  # J = 4 / 6
        runs = []
        for seed in range(40):
            turn = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            a, b = (np.unique(shingling.mix(np.concatenate([shared, o]) + turn)) for o in own)
            sketch = minhash.sketches([a, b])
            assert (sketch < np.iinfo(np.uint64).max).all()
            alone = minhash.sketches([b])
            assert (alone[0] == sketch[1]).all()
            runs.append((sketch[0] == sketch[1]).mean())
        assert abs(np.mean(runs) - 4 / 6) < 0.03
        assert np.std(runs) < 1.5 * math.sqrt(4 / 6 * 2 / 6 / (minhash.BANDS * minhash.ROWS))


def test_rounds_end_when_the_last_coordinate_is_filled(monkeypatch):
    # A hash that puts everything into coordinate 0 leaves the rest to the second half of the rounds.
    monkeypatch.setattr(minhash, "mix", lambda x: x & np.uint64(0xFFFF))
    sketch = minhash.sketches([np.arange(1, 5, dtype=np.uint64)], 16)
    assert (sketch >> np.uint64(54)).tolist()[0] == [0, *range(17, 32)]


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x {word} y"), (2, f"x {other} y"), (3, f"x {word} y z"), (4, f"x {other} y z")], "doc_id long, text string")
    for near in (minhash, ngram_join):
        assert [r["component_id"] for r in near.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    hashes, _ = shingling.word_hashes([word.encode(), other.encode()])
    assert hashes[0] != hashes[1]


# ---- queries ----


@here
@pytest.mark.parametrize("name", ["op11_resample", "op13_prefix_trie"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in made.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == sorted(made.fetchall(), key=repr)


@here
def test_minhash_query_against_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.queries()["op12_minhash"](spark, SF).collect()), key=repr)
    assert got == components(docs, 4, 80)
