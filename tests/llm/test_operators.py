"""Every corpus operator on edge cases and against brute force."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from murmurlake.llm import bpe, decontaminate, exact_dedup, graph, html_extract, line_dedup, ngram_join, pii, set_groups, suffix_dedup, token_count, toxicity

SCHEMA = "doc_id long, text string, lang string, key string, token string, n long, a string, lid string, cls string, lo string, data string, chars string, norm string"
EXTRA = len(SCHEMA.split(",")) - 2


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 3, 1, *["x"] * (EXTRA - 4)) for r in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    base = words(rng, 150)
    near = base.split()
    near[70] = "other"
    passage = words(rng, 60)
    rows = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, words(rng, 40) + " " + passage + " " + words(rng, 30)),
        (5, words(rng, 30) + " " + passage),
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (9, "one"),
        (10, "ab" * 400),
        (11, words(rng, 3000)),
        (12, "Uno dos\ntres\ncuatro\ncinco\nUno dos\ntres\ncuatro"),
        (13, "x\nUno dos\ntres\ncuatro\ny"),
        (14, "🔥 ünï😀" * 20),
        (2, base),
        (None, base.upper()),
    ]
    return table(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).limit(0)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


# ---- 1 ----


def removed(texts, length):
    data = [t.encode() for t in texts]
    seen = collections.Counter(s[i : i + length] for s in data for i in range(len(s) - length + 1))
    out = []
    for s in data:
        gone = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(s), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(s, dtype=np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot"), [(200, 3000), (30, 2)])
def test_repeats(spark, docs, none, length, hot):
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(docs, length, hot)).collect()
    rows = rows_of(docs)
    want = [(i, *r) for (i, _), r in zip(rows, removed([t for _, t in rows], length), strict=True)]
    assert counted(got) == counted(want)
    assert suffix_dedup.digests(suffix_dedup.remove_repeats(none)).count() == 0


def test_run_index():
    rng = random.Random(3)
    for _ in range(100):
        strings = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 50))) for _ in range(rng.randint(1, 5))]
        length = rng.randint(1, 10)
        seen = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
        assert [[i for a, b in r for i in range(a, b)] for r in suffix_dedup.RunIndex(strings).long_matches(length)] == want


# ---- 2 ----


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_infix_distance():
    rng = random.Random(4)
    for _ in range(300):
        p, t = ("".join(rng.choices("abc", k=rng.randint(a, 12))) for a in (1, 0))
        assert decontaminate.infix_distance(p, t) == distance(p, t)


def test_pieces_bound_the_distance():
    """Pieces never say no where the distance is small enough, and say no to most of the rest."""
    rng = random.Random(14)
    items = ["".join(rng.choices("abcdé中 ", k=rng.randint(1, 200))) for _ in range(60)]
    pieces, which, regions = decontaminate.Pieces(items), [], []
    for n, text in enumerate(items):
        for edits in (0, len(text) // 10, len(text) // 5, len(text) // 2):
            own = list(text)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(["", "x", "yz"])
            which.append(n)
            regions.append("".join(rng.choices("abc ", k=rng.randint(0, 60))) + "".join(own))
    may = pieces.may_match(which, regions)
    for n, region, near in zip(which, regions, may, strict=True):
        assert near or distance(items[n], region) > decontaminate.most_edits(len(items[n]))
    assert not pieces.may_match([n for n in which if len(items[n]) > 30], ["x y " * 30 for n in which if len(items[n]) > 30]).any()


def test_leaks(spark, docs, none):
    rng = random.Random(5)
    item = "the quick brown fox jumps over the lazy dog while seven wizards hex the king in his old castle by night"
    edited = item.replace("brown", "brwn").replace("seven", "sevven")
    held = {20: "intro " + item.upper() + " end", 21: words(rng, 50) + " " + edited, 22: words(rng, 80), 23: "so: tiny one!", 24: None, 25: item[:40]}
    both = table(spark, list(held.items())).unionByName(docs)
    items = spark.createDataFrame([(1, item), (2, "tiny one"), (3, None), (4, "  "), (1, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(both, items).collect()}
    assert got == {(20, 1, 0), (21, 1, 2), (23, 2, 0)}
    kept = decontaminate.keep_clean(both, items)
    assert kept.columns == both.columns and kept.count() == both.count() - 3
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.keep_clean(both, items.limit(0)).count() == both.count()


def test_leaks_recall():
    """Every item with up to a tenth of its characters edited, held against the distance itself."""
    rng = random.Random(6)
    items = [(i, " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(25))) for i in range(60)]
    searcher, found = decontaminate.Searcher(items), 0
    for i, text in items:
        own = list(text)
        for p in rng.sample(range(len(own)), len(own) // 10):
            own[p] = rng.choice("xyz")
        found += i in searcher.matches([words(rng, 40) + " " + "".join(own) + " " + words(rng, 40)])[0]
    assert found >= 0.9 * len(items)


def test_exact_copies_of_every_length():
    """Items of 12 to 110 bytes, at even and odd words of a text."""
    rng = random.Random(12)
    long = ["".join(rng.choices("abcdefghijklmnopñ", k=rng.randint(2, 9))) for _ in range(40)]
    items = [(i, " ".join(rng.sample(long, 25))[: 12 + i].strip("ñ ") + "x") for i in range(100)]
    searcher = decontaminate.Searcher(items)
    for i, text in items:
        for before in (30, 31):
            assert searcher.matches([words(rng, before) + " " + text + " " + words(rng, 30)])[0].get(i) == (0, len(text))


@pytest.mark.parametrize("size", [7, 12, 20, 26, 40, 50, 70, 120, 240])
def test_leaks_recall_by_length(size):
    """A fifth of the characters substituted, inserted or deleted, in items of each length class."""
    rng = random.Random(size)
    long = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000))
    items = [(i, long[200 * i : 200 * i + size].strip().ljust(size, "a")) for i in range(30)]
    searcher, texts = decontaminate.Searcher(items), []
    for _, text in items:
        own = list(text)
        for _ in range(size // 5):
            p, kind = rng.randrange(1, len(own) - 1), rng.randrange(3)
            own[p : p + (kind < 2)] = [rng.choice("abcxyz")] * (kind != 1)
        texts.append(words(rng, 41) + " " + "".join(own) + " " + words(rng, 40))
    found = sum(i in m for (i, _), m in zip(items, searcher.matches(texts), strict=True))
    assert found >= 0.9 * len(items)


def test_items_without_an_id(spark, docs):
    passage = docs.filter("doc_id = 5").first()["text"][-200:]
    items = spark.createDataFrame([(None, passage), (None, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(docs, items).collect()} >= {(5, None, 0)}
    assert decontaminate.keep_clean(docs, items).filter("doc_id = 5").count() == 0


def test_short_items_end_at_words():
    assert decontaminate.Searcher([(1, "planet")]).matches(["a plant x", "explanets", "pla net", "planets", "a (planet)"]) == [{1: (1, 6)}, {}, {1: (1, 6)}, {1: (1, 6)}, {1: (0, 6)}]


# ---- 3 ----


def test_feistel_is_a_permutation():
    net = pii.Feistel(b"key", "t", 997)
    made = [net.apply(i) for i in range(997)]
    assert sorted(made) == list(range(997)) and [net.invert(m) for m in made] == list(range(997))


def test_pii(spark, docs, none):
    rows = [
        (1, "card 4111 1111 1111 1111, again 4111111111111111; not 4111111111111112"),
        (2, "call +1 (239) 555-6884 or 1990-02-30, born 1992-02-29, ip 10.20.30.40, not 300.1.1.1"),
        (3, "mail a.b9@x.example.com ssn 123-45-6789 not 000-45-6789 DE89 3704 0044 0532 0130 00"),
        (4, "same 4111111111111111"),
    ]
    got = {r["doc_id"]: r for r in pii.documents_with_pii(table(spark, rows).unionByName(docs), "k").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert [got[i]["kinds"] for i in (1, 2, 3)] == ["card", "date,ipv4,phone", "email,iban,ssn"]
    one, two = got[1]["pseudonyms"].split("|")
    assert one.replace(" ", "") == two == got[4]["pseudonyms"] and pii.luhn(two) and "4111111111111112" in got[1]["text"]
    again = pii.Pseudonyms(b"k")
    for kind, text in (("date", "31.12.1999"), ("ipv4", "1.2.3.4"), ("phone", "+49 170 1234567")):
        made = again.of(kind, text)
        assert made != text and re.sub(r"\d", "9", made).replace("9", "") == re.sub(r"\d", "9", text).replace("9", "")
    assert pii.documents_with_pii(none, "k").count() == 0


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("pay 4111 1111 1111 1111 12/25 now", "card", "4111 1111 1111 1111"),
    ("4111111111111111 123", "card", "4111111111111111"),
    ("4111-1111-1111-1111-123", "card", "4111-1111-1111-1111"),
    ("to AT61 1904 3002 3457 3201 BIC", "iban", "AT61 1904 3002 3457 3201"),
    ("to AT61 1904 3002 3457 3201 CODE BIC", "iban", "AT61 1904 3002 3457 3201"),
    ("+49 170 1234567 2024 1231", "phone", "+49 170 1234567"),
])
def test_pii_before_other_groups(text, kind, value):
    assert [(k, v) for k, _, _, v, _ in pii.findings(text, pii.Pseudonyms(b"k"))] == [(kind, value)]


def test_dates_are_linked_in_every_order():
    names, rng = pii.Pseudonyms(b"k"), random.Random(13)
    for _ in range(500):
        y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
        forms = [f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}", *([f"{m}/{d}/{y}"] if d > 12 else [])]
        assert len({pii.read_date(names.of("date", f))[0] for f in forms}) == 1
    days = {pii.read_date(names.of("date", f"2000-{m:02d}-{d:02d}"))[0] for m in range(1, 13) for d in range(1, 29)}
    assert len(days) == 12 * 28


def test_pii_against_a_plain_search(spark):
    """Values planted among other words and numbers, against a validation of every word by itself; long and null texts, clashing columns."""
    rng, rows, want = random.Random(15), [(None, None), (0, ""), (1, "word " * 50_000 + "10.1.2.3")], {1: ["10.1.2.3"]}
    for i in range(2, 150):
        body = "".join(rng.choices("123456789", k=15))
        own = [body + pii.luhn_digit(body), body + str((int(pii.luhn_digit(body)) + 1) % 10), f"{rng.randint(1, 300)}.{rng.randint(0, 255)}.7.9", f"{rng.randint(100, 899)}-{rng.randint(0, 99):02d}-1234"]
        rng.shuffle(own)
        rows.append((i, " ".join(x for w in own for x in (w, words(rng, 3)))))
        want[i] = [w for w in own if (w.isdigit() and pii.luhn(w)) or (w.count(".") == 3 and int(w.split(".")[0]) < 256) or (w.count("-") == 2 and w[:3] != "666" and w[4:6] != "00")]
    made = pii.pseudonymise(table(spark, rows), "k").collect()
    texts = dict(rows)
    got = {r["doc_id"]: [texts[r["doc_id"]][f["start"] : f["end"]] for f in r["findings"]] for r in made if r["findings"]}
    assert got == {i: w for i, w in want.items() if w}


# ---- 4 ----


def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1000, 1600):
        bad = i % 5 == 0
        rows.append((i, words(rng, 60) + (f" you are a {rng.choice(['zork', 'blurgish', 'blurgon', 'blurgat'])} {words(rng, 3)}" if bad else "")))
        labels.append((i, 1, int(bad)))
    all_docs, known = table(spark, rows).unionByName(docs), spark.createDataFrame([*labels, (None, 1, 1), (1000, 1, None)], "doc_id long, quality int, toxic int")
    grammar = toxicity.train(all_docs, known)
    got = {r["doc_id"]: r for r in toxicity.score_documents(all_docs, grammar).collect()}
    held = [i for i in range(1000, 1600) if got[i]["held_out"]]
    assert len(held) > 80 and all(got[i]["predicted"] == (i % 5 == 0) for i in held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[6]["predicted"] == 0
    assert grammar.score("he said you are not a zork") < grammar.score("you are a zork")
    kept = toxicity.keep_civil(all_docs, grammar)
    assert kept.columns == all_docs.columns and kept.count() == all_docs.count() - 120
    nothing = toxicity.train(all_docs, known.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, nothing).collect()} == {0.0}
    assert toxicity.score_documents(none, grammar).count() == 0


def test_composed_grammar():
    """The product of the machines does what they do in turn, and the lexicon is the same however rows come."""
    rng = random.Random(11)
    for _ in range(200):
        symbols = rng.choices(range(toxicity.SYMBOLS), k=rng.randint(0, 25))
        want = [np.prod(w) for w in zip(*(m.run(symbols) for m in toxicity.MACHINES), strict=True)]
        assert toxicity.GRAMMAR.run(symbols) == pytest.approx(want)
    grammar = toxicity.Grammar(words={"zork": 0.9})
    assert grammar.clause("you zork".split()) == pytest.approx((1.08, 1, 0, 0))
    assert grammar.clause("she said not a zork".split()) == pytest.approx((0.9 * 0.4 * 0.6 * 1.2, 1, 1, 0))
    assert grammar.clause("i will hurt you".split())[3] == 0 and grammar.clause("you i will hurt".split())[3] == 1
    rows = [(f"{words(rng, 20)} zork {words(rng, 5)}" if i % 3 == 0 else words(rng, 25), i % 3 == 0) for i in range(90)]
    learned = [toxicity.learn([t for t, _ in r], [b for _, b in r]) for r in (rows, rows[::-1], [*rows, *rows[:30]])]
    assert all(g.words.keys() == {"zork"} and g.weights == pytest.approx(learned[0].weights) for g in learned)
    copies = toxicity.learn([f"quiet lamp blue fish stands on some long table here {i}" for i in range(40)] + [words(rng, 25) for _ in range(90)], [True] * 40 + [False] * 90)
    assert not copies.words.keys() & {"quiet", "lamp", "blue", "fish", "stands"}  # near copies of one text are no evidence


def test_long_and_odd_texts_score(spark):
    grammar = toxicity.Grammar(words={"zork": 0.9}, weights=[-3.0, 4.0, 1.0, 0.0, 0.0, 0.0, 0.0])
    rows = [(1, "calm " * 50_000 + "you zork"), (2, "calm " * 50_000), (None, None), (3, "")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(table(spark, rows), grammar).collect()}
    assert got == {1: 1, 2: 0, None: 0, 3: 0}


# ---- 5 ----


def components_of(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets.append((i, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 90 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def test_ngram_join(spark, docs, none):
    got = ngram_join.near_duplicates(docs).collect()
    assert counted(got) == counted(components_of(rows_of(docs)))
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """More near copies than a small bucket holds, with few and many edits: pivots and further levels."""
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(set_groups, "SMALL", 4)
    monkeypatch.setattr(set_groups, "SMALL_IN_GROUP", 4)
    rng = random.Random(9)
    base = words(rng, 120, 10**6).split()
    rows = []
    for i in range(70):
        own = list(base)
        for p in rng.sample(range(120), rng.randint(0, 5)):
            own[p] = f"e{rng.randint(0, 5)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, words(rng, 60)) for i in range(20)]
    assert counted(ngram_join.near_duplicates(table(spark, rows)).collect()) == counted(components_of(rows))


def test_ngram_join_of_rows_without_ids(spark):
    """Null ids link, also where they alone connect two others; long documents, and ids that several texts share."""
    rng = random.Random(21)
    base = words(rng, 200, 10**6).split()
    near = [*base[:-6], *(f"x{i}" for i in range(6))]
    far = [*(f"y{i}" for i in range(6)), *base[6:]]
    long = words(rng, 20_000, 10**6)
    rows = [(None, " ".join(base)), (5, " ".join(near)), (6, " ".join(near + ["tail"])), (9, " ".join(far)), (4, long), (3, long + " end"), (3, "a b c"), (None, None), (8, "a b c")]
    want = components_of([(i, t or "") for i, t in rows])
    assert counted(ngram_join.near_duplicates(table(spark, rows)).collect()) == counted(want)
    kept = ngram_join.one_of_each(table(spark, [*rows, (8, "  A b C"), (3, long + " end")]))
    assert kept.columns == table(spark, []).columns
    assert counted((r["doc_id"], r["text"] and len(r["text"])) for r in kept.collect()) == counted([(5, len(" ".join(near))), (3, len(long) + 4), (3, 5), (None, None)])


def test_token_levels(spark, docs, none):
    """Exact counts behind the table: a slot's level is that of its most frequent token."""
    n = collections.Counter()
    sets = {s.tobytes(): s for s in ngram_join.shingles([t.encode() for _, t in rows_of(docs)], ngram_join.WORDS)}.values()
    for s in sets:
        n.update(s.tolist())
    got, want = ngram_join.token_levels(docs), collections.Counter()
    for t, k in n.items():
        if k > 1:
            want[t >> 42] = max(want[t >> 42], round(8 * np.log2(k)))
    seen = {i: int(got[i]) for i in np.flatnonzero(got).tolist()}
    assert set(seen) >= set(want) and all(seen[i] >= v for i, v in want.items())
    assert not ngram_join.token_levels(none).any()


def test_token_levels_make_room_for_all_frequent_tokens(spark, monkeypatch):
    """Were there no room, prefixes would hold tokens of many documents, and groups of unlike documents would come of them."""
    monkeypatch.setattr(ngram_join, "SLOT_BITS", 8)
    # 150 passages, each in 30 documents, with 40 words of their own: unlike documents that share frequent tokens.
    rows = [(i, " ".join([f"p{i % 150}w{j}" for j in range(20)] + [f"d{i}w{j}" for j in range(40)])) for i in range(4500)]
    docs = table(spark, rows)
    levels = ngram_join.token_levels(docs)
    frequent = np.unique(np.concatenate(ngram_join.shingles([" ".join(f"p{k}w{j}" for j in range(20)).encode() for k in range(150)], ngram_join.WORDS)))
    slots = frequent >> np.uint64(64 - (len(levels).bit_length() - 1))
    assert len(frequent) == 2700 and (levels[slots.astype(np.int64)] >= round(8 * np.log2(30))).all()
    assert (levels > 0).mean() <= 0.25
    shared = {int(t) for t in frequent.view(np.int64)}
    prefixes = [set(r["prefix"]) for r in ngram_join.signatures(docs, levels).select("prefix").collect()]
    assert len(prefixes) == 4500 and not any(shared & p for p in prefixes)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


# ---- 6, 10 ----


def samples():
    rng = random.Random(10)
    parts = ["a", "ab", "the ", "ing", " ", "\n", "  ", "é", "中", "😀", "1", "'s", "<|endoftext|>", "Σ", "́", "!!", "aaaaaaaaa", "zxq", "\xa0", " "]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)]
    return [*made, "a" * 5000, "ab" * 3000, "".join(rng.choices("abcdefgh", k=20000)), "=-" * 2000, "ꟋꟜ"]


def test_bpe_equals_the_library(spark, docs, none):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    own, library = bpe.TreeBpe(ranks, public.PATTERN), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in samples():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    want = []
    for i, t in rows_of(docs):
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert counted(bpe.encode_digests(docs, path, public.PATTERN).collect()) == counted(want)
    assert bpe.encode_digests(none, path, public.PATTERN).count() == 0
    assert bpe.encode_ids(docs.filter("doc_id = 14"), path, public.PATTERN).first()["decoded"] == "🔥 ünï😀" * 20


def test_bpe_joins_halves(monkeypatch):
    """Most pieces of an ordinary text that aren't tokens go up the tree, at every size of leaf with the same result."""
    import tiktoken

    ranks, joins, join = bpe.load_ranks(public.path("byte_bpe_50k.tiktoken")), [], bpe.TreeBpe.join
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe.TreeBpe, "join", lambda self, a, b: joins.append(len(a) + len(b)) or join(self, a, b))
    text = "Unquestionably multifarious Geschwindigkeitsbegrenzungen désensibilisations irreconocible " * 3 + "x" * 700
    for leaf in (1, 2, 4, 24):
        joins.clear()
        monkeypatch.setattr(bpe, "LEAF", leaf)
        own = bpe.TreeBpe(ranks, public.PATTERN)
        assert own.encode(text) == library.encode_ordinary(text)
        assert leaf > 4 or len(joins) > 20
    if os.path.isdir("/root/testdata/sf0.001"):
        import pyarrow.parquet as pq

        monkeypatch.setattr(bpe, "LEAF", 4)
        joins.clear()
        own = bpe.TreeBpe(ranks, public.PATTERN)
        texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
        pieces = {p for t in texts for p in own.split.findall(t or "")}
        missed = [p for p in pieces if p.encode() not in ranks and len(p.encode()) > 4]
        for p in missed:
            own.piece(p.encode())
        assert len(joins) >= len(missed) > 1000


def test_token_counts_equal_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_count.WordBpe(path)
    texts = samples()
    assert own.count_all(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    want = []
    for i, t in rows_of(docs):
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 2048))
    assert counted(token_count.token_counts(docs, path).collect()) == counted(want)
    assert token_count.token_counts(none, path).count() == 0


# ---- 7 ----


def test_line_dedup(spark, docs, none):
    done = line_dedup.remove_repeated_lines(docs)
    got = {r["doc_id"]: r["line_dedup"] for r in done.collect()}
    assert done.columns[:-1] == docs.columns
    assert got[12]["kept_text"] == "Uno dos\ntres\ncuatro\ncinco" and got[12]["n_removed"] == 3
    assert got[13]["kept_text"] == "x\ny" and got[6]["kept_text"] is None and got[9]["kept_text"] == "one"
    blank = table(spark, [(1, "\n\n\n\n"), (2, "\n\n\n"), (3, "a\nb\nc\nd"), (4, "a\nb\nc\nd")])
    got = {r["doc_id"]: r["line_dedup"]["kept_text"] for r in line_dedup.remove_repeated_lines(blank).collect()}
    assert got == {1: "\n\n\n\n", 2: "\n\n\n", 3: "a\nb\nc\nd", 4: ""}
    assert line_dedup.remove_repeated_lines(none).count() == 0


def test_line_dedup_beside_a_column_of_its_name(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "kept"), (2, "a\nb\nc", "kept")], "doc_id long, text string, line_dedup string")
    with pytest.raises(ValueError):
        line_dedup.remove_repeated_lines(rows)
    got = line_dedup.remove_repeated_lines(rows, into="found").orderBy("doc_id").collect()
    assert [(r["line_dedup"], r["found"]["n_removed"]) for r in got] == [("kept", 0), ("kept", 3)]


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(4, "a\nb\nc"), (5, "a\nb\nc"), (5, "x\ny\nz"), (None, "p\nq\nr"), (None, "x\ny\nz\nw"), (9, "l\n" * 30_000)]
    got = {(r["doc_id"], r["text"][:8]): r["line_dedup"] for r in line_dedup.remove_repeated_lines(table(spark, rows)).collect()}
    assert {k: v["kept_text"] for k, v in got.items() if k[0] != 9} == {
        (4, "a\nb\nc"[:8]): "a\nb\nc", (5, "a\nb\nc"): "", (5, "x\ny\nz"): "", (None, "p\nq\nr"): "p\nq\nr", (None, "x\ny\nz\nw"): "x\ny\nz\nw"}
    assert got[9, "l\nl\nl\nl\n"]["n_removed"] == 29_999


# ---- 8 ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies for a great many things on this site</div><article><h1>Big &amp; news</h1><p>First <b>bold</b>
 para&nbsp;here<div class="ad">buy now</div><p>Second &#233; one<ul><li>item<li>more</ul><aside>side</aside><form>mail</form></article>
<section id="comments"><p>what a good page this is, really very good</p></section><footer>end</footer></body></html>"""
MAIN = "Big & news\nFirst bold para here\nSecond é one\nitem\nmore"


def test_html(spark):
    weights = html_extract.learn([PAGE] * 3)
    assert html_extract.main_text(PAGE, weights) == MAIN
    assert html_extract.main_text(PAGE.replace("article>", "div>"), weights) == MAIN
    assert html_extract.main_text(PAGE, {}) == MAIN
    for odd in ("", None, "plain text", "<p", "<a href='x>y</a>", "<p>open <b>tags", "</p></div>text", "<!-- open"):
        assert isinstance(html_extract.main_text(odd, weights), str)
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract_main_text(pages).collect()
    assert counted(got) == counted([(1, "u", MAIN, len(MAIN))] * 2 + [(2, None, "", 0), (3, "u", "", 0)])
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_learning_from_marked_pages(spark):
    """Nested and unclosed containers don't turn inside and outside round; long pages and extra columns are read whole."""
    nested = "<body><p>menu words here</p><main><article><p>one two</p></article><p>three</p></main><div>foot note</div>"
    marked = []
    found = html_extract.tokens(nested, marked)
    assert [t for (k, t, _), own in zip(found, marked, strict=True) if k[0] == "w" and own] == ["one two", "three"]
    marked.clear()
    assert [t for (k, t, _), own in zip(html_extract.tokens("<p>a</p><article><p>b<p>c", marked), marked, strict=True) if k[0] == "w" and own] == ["b", "c"]
    page = "<body><nav>x</nav><article>" + "".join(f"<p>word {i} of many</p>" for i in range(20_000)) + "</article></body>"
    pages = spark.createDataFrame([(1, "u", page, "w", 3)], "page_id long, url string, html string, text string, n_chars long")
    row = html_extract.extract_main_text(pages).first()
    assert row["text"] == "\n".join(f"word {i} of many" for i in range(20_000)) and row["n_chars"] == len(row["text"])


# ---- 9 ----


@pytest.mark.parametrize(("capacity", "depth", "key"), [(50_000, 4, None), (2, 1, None), (2, 1, lambda norm: F.length(norm) % 3)])
def test_exact_dedup(spark, docs, none, capacity, depth, key):
    more = table(spark, [(30, "o n e"), (31, "one"), (29, "o\tn\te"), (32, "on e")])
    both = docs.unionByName(more)
    got = exact_dedup.group_of_rows(both, capacity, key or exact_dedup.default_key, depth).collect()
    groups = collections.defaultdict(list)
    for i, t in rows_of(both):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i))
    want = []
    for norm, members in groups.items():
        keep = min(members)[2]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in members]
    assert counted(got) == counted(want)
    assert exact_dedup.group_of_rows(none).count() == 0


def test_directory_leads_rows_to_their_entries(spark, docs, monkeypatch):
    """Buckets split until they fit, owners keep their ranges without a further exchange, and a wrong slot loses its rows."""
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    depth, slots = exact_dedup.directory(keys, 100, 1)
    held = slots.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    assert len(held) > 16 and all(r["n"] <= 100 for r in held) and sum(r["n"] for r in held) == 2000
    whole = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: (lambda d, s: (d, s.filter("slot % 2 = 0")))(*whole(*a)))
    assert 0 < exact_dedup.group_of_rows(docs, 2, start_depth=1).count() < docs.count()


def test_buckets_of_the_given_tables_split(spark):
    for sf in ("/root/testdata/sf0.1",):
        if not os.path.isdir(sf):
            pytest.skip("the driver's tables are not here")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        keys = docs.select(exact_dedup.default_key(exact_dedup.normalised(F.coalesce("text", F.lit("")))).alias("key"))
        slots = exact_dedup.directory(keys)[1]
        held = slots.groupBy("bucket", "depth").agg(F.sum("n").alias("n"))
        assert held.agg(F.min("depth"), F.max("n")).first()[0] > exact_dedup.START_DEPTH
        assert held.filter(F.col("n") > exact_dedup.CAPACITY).count() == 0
