"""Exact clusters and greedy leader groups of activities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.stored import stored
from murmurlake.functions.text import round_half_up, squeezed

SIMILAR = 0.95


def cluster_key() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.lower(c), F.lit("")) for c in ("media_key", "place_name", "city", "country")])


def exact_clusters(activities: DataFrame) -> DataFrame:
    """cluster_key, representative (activity_id of the best score, first of equals), instance_count, first/last mention, senders."""
    times = F.transform("messages", lambda m: m["timestamp"])
    return (
        activities.withColumn("cluster_key", cluster_key())
        .groupBy("cluster_key")
        .agg(
            F.max_by("activity_id", F.struct("score", -F.col("ord"))).alias("representative"),
            F.count("*").alias("instance_count"),
            F.min(F.array_min(times)).alias("first_mentioned"),
            F.max(F.array_max(times)).alias("last_mentioned"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("messages", lambda m: m["sender"]))))).alias("all_senders"),
        )
    )


def _grams(text: Column, q: int = 3) -> Column:
    """The q-grams of a text, each with how often it stood before, so that equal ones count apart."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    return F.transform(grams, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).alias("nth")))


def _allowed(longer: Column) -> Column:
    """Edits that leave a similarity of ``SIMILAR`` where the longer text has so many characters."""
    return F.floor(longer * (1 - SIMILAR) + 1e-9).cast("int")


def similar_texts(texts: DataFrame) -> DataFrame:
    """a, b: every two different texts (column ``text``) with 1 - distance / longer length of at least ``SIMILAR``, in both orders.

    k edits change at most 3k of a text's 3-grams, so of two such texts each has one of the other's among its first 3k + 1, whatever the
    order; rare grams come first.  Two texts of under 20 characters allow no edit, so they are similar only if equal.
    """
    shortest = int(1 / (1 - SIMILAR) + 1e-6) - 1  # the shorter of two of which the longer allows one edit
    long = texts.filter(F.length("text") >= shortest).select("text").distinct()
    held = long.select("text", F.explode(_grams(F.col("text"))).alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    ranked = held.join(often, "g").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("grams"))
    # The longer of two has at most 1 / SIMILAR times the characters.
    reach = _allowed(F.ceil(F.length("text") / SIMILAR - 1e-9)) * 3 + 1
    first = ranked.select("text", F.explode(F.slice("grams", F.lit(1), reach)).alias("x")).select("text", "x.g")
    pairs = first.select("g", F.col("text").alias("a")).join(first.select("g", F.col("text").alias("b")), "g").filter("a < b")
    most_edits = _allowed(F.greatest(F.length("a"), F.length("b")))
    near = pairs.filter(F.abs(F.length("a") - F.length("b")) <= most_edits).select("a", "b").distinct()
    found = near.filter(F.levenshtein("a", "b") <= most_edits)
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: What two rules compare besides the text: titles alike, or places alike; empty fields match anything, a title never does.
_RULES = {"title": ("city", "country"), "place": ("media_key", "place_name", "city", "region", "country", "wiki_name")}


def _mask(fields: tuple[str, ...]) -> Column:
    """Which of the fields aren't empty, a bit each."""
    return sum((F.when(F.col(f) != "", 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0))


def _key(rule: str, shared: Column) -> Column:
    """What rows must have in common where they both have the fields ``shared``."""
    held = [F.when(shared.bitwiseAND(F.lit(1 << i)) > 0, F.col(f)).otherwise("") for i, f in enumerate(_RULES[rule])]
    return F.array("link_key", *([F.col("title")] if rule == "title" else []), *held)


def _dealt(profiles: DataFrame, rule: str, alike: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers and questions (ord, rule, mask, shared, key).  A profile offers itself under its own mask and every mask it may share with
    another; it asks each mask that occurs, with what both have.  A question meets an offer if and only if the rule holds."""
    fields = _RULES[rule]
    masked = profiles.withColumn("own", _mask(fields))
    masks = sorted(r["own"] for r in masked.select("own").distinct().collect())  # at most 2 ** 6
    shares = F.map_from_arrays(F.array(*map(F.lit, masks)), F.array(*[F.array(*map(F.lit, sorted({p & q for q in masks}))) for p in masks])) if masks else F.lit(None)
    offers = masked.withColumns({"mask": F.col("own"), "shared": F.explode(F.element_at(shares, F.col("own")) if masks else F.array(F.lit(0)))})
    asks = masked.withColumn("mask", F.explode(F.array(*map(F.lit, masks)) if masks else F.array(F.lit(0))))
    asks = asks.withColumn("shared", F.col("mask").bitwiseAND(F.col("own")))
    text = "title" if rule == "title" else "place_name"
    near = asks.join(alike.select(F.col("a").alias(text), F.col("b").alias("_near")), text)
    if rule == "place":  # an equal place is asked for already where it isn't shared
        near = near.filter(F.col("shared").bitwiseAND(F.lit(1 << fields.index(text))) > 0)
    asks = asks.unionByName(near.withColumn(text, F.col("_near")).drop("_near"))
    return tuple(rows.select("ord", F.lit(rule).alias("rule"), "mask", "shared", _key(rule, F.col("shared")).alias("key")) for rows in (offers, asks))


def leader_groups(activities: DataFrame) -> DataFrame:
    """ord, leader_ord: in input order, each row joins the first leader it goes with, or leads itself.

    Two rows go together if their links are equal and either titles are alike and city and country are equal or empty, or all of place (alike),
    media key, city, region, country and wiki name are equal or empty.  Rows that are equal in all these share their leader, so only
    *profiles* are compared, and only the least ord behind a key is ever told, so no pairs are made: an empty field is another
    mask, and texts that are alike (not equal) are asked for by each name.  A profile whose first match among those that may still lead is
    itself leads; one whose first match leads follows it; others wait for the next round, in which followers offer themselves no more.
    Rounds are as many as the longest chain of profiles that wait for each other.
    """
    link = F.when(F.col("link").isNull(), F.lit("")).otherwise(F.concat_ws("|", F.lit("l"), "link.type", squeezed(F.col("link.query"))))
    fields = list(_RULES["place"])
    told = [link.alias("link_key"), squeezed(F.coalesce("activity", F.lit(""))).alias("title"), *[squeezed(F.coalesce(f, F.lit(""))).alias(f) for f in fields]]
    profile = ["link_key", "title", *fields]
    rows = stored(activities.select("ord", *told), "leader-rows")
    profiles = stored(rows.groupBy(*profile).agg(F.min("ord").alias("ord")), "leader-profiles")
    parts = []
    for rule, text in (("title", "title"), ("place", "place_name")):
        alike = stored(similar_texts(profiles.select(F.col(text).alias("text"))), "leader-alike")
        parts.append(_dealt(profiles, rule, alike))
    columns = ["rule", "mask", "shared", "key"]
    offers, asks = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    keys = stored(asks.select(*columns).distinct().withColumn("kid", F.monotonically_increasing_id()), "leader-keys")
    offers = stored(offers.join(keys, columns).select("kid", "ord"), "leader-offers")
    asks = stored(asks.join(keys, columns).select("kid", F.col("ord").alias("asker")), "leader-asks")
    decided: list[DataFrame] = []
    while True:
        least = offers.groupBy("kid").agg(F.min("ord").alias("first"))
        first = stored(asks.join(least, "kid").groupBy("asker").agg(F.min("first").alias("first")), "leader-first")
        if first.isEmpty():
            break
        leads = reduce(DataFrame.unionByName, [*decided, first]).filter("asker = first").select(F.col("asker").alias("leader"))
        done = stored(first.join(leads, F.col("first") == F.col("leader"), "left_semi"), "leader-decided")
        decided.append(done)
        asks = stored(asks.join(done.select("asker"), "asker", "left_anti"), "leader-asks")
        offers = stored(offers.join(done.filter("asker <> first").select(F.col("asker").alias("ord")), "ord", "left_anti"), "leader-offers")
    if not decided:
        return rows.select("ord", F.col("ord").alias("leader_ord"))
    named = profiles.join(reduce(DataFrame.unionByName, decided), F.col("ord") == F.col("asker")).select(*profile, F.col("first").alias("leader_ord"))
    return rows.join(named, profile).select("ord", "leader_ord")


def merge_groups(activities: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a group: the leader's fields, scores as rounded means, messages one after another."""
    told = activities.join(groups, "ord")
    merged = told.groupBy("leader_ord").agg(
        round_half_up(F.avg("fun_score"), 1).alias("fun_score"),
        round_half_up(F.avg("interesting_score"), 1).alias("interesting_score"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "messages"))), lambda x: x["messages"])).alias("messages"),
    )
    rest = activities.drop("fun_score", "interesting_score", "score", "messages")
    made = rest.join(merged, rest["ord"] == merged["leader_ord"]).drop("leader_ord")
    return made.withColumn("score", round_half_up((F.col("interesting_score") * 2 + F.col("fun_score")) / 3, 1))


def mention_stats(activities: DataFrame) -> DataFrame:
    times = F.transform("messages", lambda m: m["timestamp"])
    return activities.select("activity_id", F.size("messages").alias("mentions"), F.array_min(times).alias("first_at"), F.array_max(times).alias("last_at"))


def most_wanted(activities: DataFrame, limit: int = 10) -> DataFrame:
    return activities.filter(F.size("messages") > 1).orderBy("ord").limit(limit)


def mentioned_at_least(activities: DataFrame, n: int) -> DataFrame:
    """Activities that at least ``n`` messages mention."""
    return activities.filter(F.size("messages") >= n)
