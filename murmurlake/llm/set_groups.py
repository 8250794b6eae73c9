"""Links within large groups of sets, without pairs of a whole group.

Classes (distinct sets) that share a bucket may link; buckets of up to ``SMALL`` classes make pairs.  A larger bucket's classes form a *group*, and
each is described by its difference D to the group's *pivot*, the tokens that about half of the group holds; any set would do, this one
makes differences small.  Two sets link at a Jaccard similarity of t = times/per.  As |x ^ y| = |D(x) ^ D(y)|, x and y link if
|D(x) ^ D(y)| <= c(|x| + |y|) with c = (1-t)/(1+t).  So with a(x) = |D(x)| - c|x|, a pair with a(x) + a(y) <= 0 always links, and both link to
the class of least a, the *hub*; which classes link with the hub is told exactly, and keeps their component without pairs.  Any other pair that
links shares an element of the differences' prefixes.  These elements are the tokens of a next level, whose sets are the differences: small buckets make pairs,
verified on differences alone, large ones are groups again.  What a large bucket shares is in its pivot, so every level leaves
less; levels go on until no token is large.  Classes that are all linked with the hub need no more levels, and a pair is looked for in the
bucket of its first common element only: what stands before that element in a difference is *barred*, as it can't be common, and
shortens the prefix.  Rows follow the sizes of the sets, never the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import forget, map_rows, written

#: Classes that a bucket may hold to make pairs; within groups, where parities tell pairs apart before they are made.
SMALL, SMALL_IN_GROUP = 24, 256
#: Levels after which the search gives up with an error; each fixes at least one token of every group that is left.
MOST_LEVELS = 200
#: Numbers of 64 bits that tell early how far two sets are apart.
LANES = 8
#: Tasks that the rows of one group are dealt to where they meet what belongs to the group.
SALTS = 8


def _may_link(n: str, m: str, times: int, per: int) -> str:
    """Sizes that allow the similarity."""
    return f"{n} * {per} >= {times} * {m} AND {m} * {per} >= {times} * {n}"


def as_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def parity(tokens: np.ndarray) -> np.ndarray:
    """``LANES`` numbers of 64 bits: for each of their bits, whether an odd number of tokens falls on it.

    A token in one of two sets alone turns one bit, so no more bits differ than tokens do: a lower bound of the symmetric difference."""
    odd = np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_near(n: str, m: str, sig: str, its: str, times: int, per: int) -> str:
    """Whether the parities of two sets of n and m tokens allow a link."""
    apart = " + ".join(f"bit_count({sig}[{i}] ^ {its}[{i}])" for i in range(LANES))
    return f"({per + times}) * ({apart}) <= ({per - times}) * ({n} + {m})"


def _with_group(rows: DataFrame, told: DataFrame, how: str = "inner") -> DataFrame:
    """The rows (grp, cls, ...) with their group's row of ``told``; a large group's rows are spread over several tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    return salted.join(told.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["grp", "_salt"], how).drop("_salt")


def _pivots(rows: DataFrame) -> DataFrame:
    """grp, base (sorted tokens): what about half of the rows of each group hold.

    Rows are dealt by ranges of (grp, cls), so a group lies together however large it is, and counted where they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def out() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n * 4 >= len(held)
            names = pa.array([None, *tokens[often].view(np.int64).tolist()], type=pa.int64())
            sums = pa.array([len(held), *n[often].tolist()], type=pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([now] * len(names), type=pa.int64()), names, sums], names=["grp", "token", "n"])

        for batch in batches:
            for grp, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) > 2 and (grp != now or len(held) >= 1024):  # one or two rows say little about the group
                    yield out()
                    held = []
                elif grp != now:
                    held = []
                now = grp
                held.append(as_set(tokens))
        if len(held) > 2:
            yield out()

    dealt = rows.select("grp", "cls", "tokens").repartitionByRange("grp", "cls").sortWithinPartitions("grp", "cls").select("grp", "tokens")
    counts = dealt.mapInArrow(run, "grp long, token long, n long").groupBy("grp", "token").agg(F.sum("n").alias("n"))
    sizes = counts.filter("token IS NULL").select("grp", F.col("n").alias("size"))
    held = counts.filter("token IS NOT NULL").join(sizes, "grp").filter("2 * n >= size")
    return held.groupBy("grp").agg(F.collect_list("token").alias("base"))


def _level(rows: DataFrame, times: int, per: int) -> DataFrame:
    """grp, cls, n, tokens (the difference to the pivot of the group), far ((1 + t) a(x) in whole numbers), barred (elements of the
    difference that no partner shares), n_free (how many others there are), keys (their prefix), sig."""

    def make():
        def work(columns: list) -> list:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
            for grp, cls, n, tokens, barred, sig, base in zip(*columns, strict=True):
                pivot = np.sort(np.array(base or [], dtype=np.int64).view(np.uint64))
                own = as_set(tokens)
                new, gone = np.setdiff1d(own, pivot, assume_unique=True), np.setdiff1d(pivot, own, assume_unique=True)
                diff = np.sort(np.concatenate([new, gone]))
                # That no partner has an element of the old difference says nothing about the new one where the pivot holds it.
                bar = np.setdiff1d(np.array(barred or [], dtype=np.int64).view(np.uint64), pivot)
                # A partner is at most per/times as large: |D(x) - D(y)| <= c(|x| + |y|) <= n * (per - times) / times.
                most = (per - times) * n // times - len(bar)
                free = np.concatenate([np.setdiff1d(new, bar, assume_unique=True), gone])  # new ones are rarer, they come first
                keys = free[: max(0, most + 1)].view(np.int64)
                values = (grp, cls, n, diff.tobytes(), (per + times) * len(diff) - (per - times) * n, bar.view(np.int64), len(free), keys, sig)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            return list(out)

        return work

    based = _with_group(rows, _pivots(rows), "left").select("grp", "cls", "n", "tokens", "barred", "sig", "base")
    kind = "grp long, cls long, n long, tokens binary, far long, barred array<long>, n_free int, keys array<long>, sig array<long>"
    return written(map_rows(based, make, kind), "group-level")


def _close(pairs: DataFrame, level: DataFrame, times: int, per: int) -> DataFrame:
    """The pairs (grp, a, b) whose differences are small enough."""

    def make():
        def work(columns: list) -> list:
            a, b = [], []
            for x, y, n, m, s, t in zip(*columns, strict=True):
                one, two = as_set(s), as_set(t)
                apart = len(one) + len(two) - 2 * len(np.intersect1d(one, two, assume_unique=True))
                if (per + times) * apart <= (per - times) * (n + m):
                    a.append(x)
                    b.append(y)
            return [a, b]

        return work

    own = level.select("grp", F.col("cls").alias("a"), "n", F.col("tokens").alias("s"))
    other = level.select("grp", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("t"))
    return map_rows(pairs.join(own, ["grp", "a"]).join(other, ["grp", "b"]).select("a", "b", "n", "m", "s", "t"), make, "a long, b long")


def buckets_of(members: DataFrame, *more: str) -> DataFrame:
    """members (token, cls, n, near) of tokens with several classes that aren't all near, with held (how many) and least (class).

    One exchange by token serves both sides; tasks have told a class once each, so copies don't weigh."""
    told = [F.first(c).alias(c) for c in ("n", "near", *more)]
    members = members.repartition("token").groupBy("token", "cls").agg(*told)
    held = members.groupBy("token").agg(F.count("*").alias("held"), F.min("cls").alias("least"), F.min("near").alias("all_near"))
    return members.join(held.filter("held > 1 AND NOT all_near").drop("all_near"), "token")


def pairs_of(buckets: DataFrame, times: int, per: int, *by: str) -> DataFrame:
    """All pairs a < b within small buckets whose sizes (and parities, where there are any) allow a link and that aren't both near the hub, with
    shared (how many buckets)."""
    sig = ["sig"] if "sig" in buckets.columns else []
    small = buckets.filter(F.col("held") <= (SMALL_IN_GROUP if sig else SMALL))
    theirs = [F.col(x).alias(y) for x, y in (("cls", "b"), ("n", "m"), ("near", "also"), *[("sig", "its_sig") for _ in sig])]
    close = may_be_near("n", "m", "sig", "its_sig", times, per) if sig else "true"
    return (
        small.select("token", *by, F.col("cls").alias("a"), "n", "near", *sig)
        .join(small.select("token", *theirs), "token")
        .filter(f"a < b AND NOT (near AND also) AND {_may_link('n', 'm', times, per)} AND {close}")
        .groupBy(*by, "a", "b")
        .agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    )


def _with_hub(level: DataFrame, times: int, per: int) -> DataFrame:
    """grp, cls, n, sig, hub, near (whether the class links with its group's hub, told exactly by their differences), far, hub_far, n_free, keys."""
    mine = F.struct("far", "cls")
    hubs = level.groupBy("grp").agg(F.min_by(F.struct("cls", "far", "n", "tokens"), mine).alias("h"))
    told = hubs.select("grp", F.col("h.cls").alias("hub"), F.col("h.far").alias("hub_far"), F.col("h.n").alias("hub_n"), F.col("h.tokens").alias("hub_tokens"))

    def make():
        def work(columns: list) -> list:
            near = []
            for n, m, s, t in zip(*columns[:4], strict=True):
                one, two = as_set(s), as_set(t)
                apart = len(one) + len(two) - 2 * len(np.intersect1d(one, two, assume_unique=True))
                near.append((per + times) * apart <= (per - times) * (n + m))
            return [near, columns[0], *columns[4:]]

        return work

    rows = _with_group(level, told).select("n", "hub_n", "tokens", "hub_tokens", "grp", "cls", "sig", "hub", "far", "hub_far", "n_free", "keys")
    return map_rows(rows, make, "near boolean, n long, grp long, cls long, sig array<long>, hub long, far long, hub_far long, n_free int, keys array<long>")


def _merged(large: DataFrame) -> DataFrame:
    """The groups (grp, cls), those that share classes mostly put together: a group goes by the least group of any of its classes, so a crowd
    that meets in many buckets is told once."""
    least = large.groupBy("cls").agg(F.min("grp").alias("first"))
    names = large.join(least, "cls").groupBy("grp").agg(F.min("first").alias("first"))
    return large.join(names, "grp").select(F.col("first").alias("grp"), "cls").distinct()


def group_links(large: DataFrame, sets: DataFrame, times: int, per: int) -> DataFrame:
    """a, b: links within the groups ``large`` (grp, cls) of ``sets`` (cls, n, tokens: sorted 64-bit numbers as bytes, sig: their parity); enough
    of them that every class that links with another of its group is connected to it."""
    found: list[DataFrame] = []
    none = F.array().cast("array<bigint>").alias("barred")
    rows = _merged(large).join(sets.select("cls", "n", "tokens", "sig"), "cls").select("grp", "cls", "n", "tokens", none, "sig")
    state = written(rows, "group-state")
    for _ in range(MOST_LEVELS):
        if state.isEmpty():
            break
        level = _level(state, times, per)
        # Two differences share at least (a(x) + a(y)) / 2 elements, so prefixes may leave out one less of the last ones.
        common = F.expr(f"greatest(1, ceil((far + hub_far) / {2 * (per + times)}))").cast("int")
        keys = F.slice("keys", F.lit(1), F.greatest(F.lit(0), F.least(F.size("keys"), F.col("n_free") - common + 1)))
        told = written(_with_hub(level, times, per).select("grp", "cls", "n", "near", "sig", "hub", keys.alias("keys")), "group-hubs")
        found.append(written(told.filter("near AND cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")), "group-links"))
        # A token of this level belongs to its group: its name is that of both.
        rows = told.select("grp", "cls", "n", "near", "sig", F.explode("keys").alias("key"))
        buckets = written(buckets_of(rows.withColumn("token", F.xxhash64("grp", "key")), "grp", "key", "sig"), "group-buckets")
        found.append(written(_close(pairs_of(buckets, times, per, "grp").select("grp", "a", "b"), level, times, per), "group-links"))
        again = buckets.filter(F.col("held") > SMALL_IN_GROUP).select("token", "grp", "key", "cls", "sig")
        before = F.expr("concat(barred, slice(keys, 1, greatest(0, cast(array_position(keys, key) AS INT) - 1)))").alias("barred")
        last, state = state, written(again.join(level.drop("sig"), ["grp", "cls"]).select(F.col("token").alias("grp"), "cls", "n", "tokens", before, "sig"), "group-state")
        forget(last, level, told, buckets)
    else:
        raise RuntimeError("groups did not become small")
    return reduce(DataFrame.unionByName, found, large.sparkSession.createDataFrame([], "a long, b long"))
