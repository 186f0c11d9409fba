"""Near-duplicate components by a grouped prefix join on word shingles (Jaccard).

All shingles have one global order: shingles seen to be frequent last, by count, the others by code. Two sets that are similar
enough share a shingle of their prefixes, the first n - ceil(t * n) + 1 shingles. Documents with the same prefix and size are
collapsed into one group and only groups are posted under their prefix shingles. Lists with one group are dropped, the
others are expanded to their members (distinct sets; exact copies are one), and members are verified on their whole sets.

No list is ever turned into all its pairs. In every round each list has one hub, chosen anew by a seeded hash; of the hubs
that a member meets and whose component it is not yet in, the nearest one by size, place and bitmap bounds is verified. What
remains is made exact at the end: in lists which still span several components, the members outside the list's largest
component meet all members of other components, again only past the bounds, and long lists are dealt to several tasks. The place
of the token in both sets bounds what they share from there on; it is kept wherever the token is their first common one. The others are safe too: shingles that both sets
hold turn the same flags over, so every flag that differs needs a shingle that is in one of them only; and a member without a
neighbour of fit size in a list leaves the list.

Whole sets are never stored. Where pairs are verified, the texts of both sides are read again and one side meets the other by
its hub. The keys of those texts are broadcast up to ``KEYS`` of them and joined with a shuffle beyond.

Frequent shingles are found by lossy counts in the map tasks, at most ``HEAVY`` are broadcast; they change the order, never
the result. Components are found with ``components`` on written edges. Sets are compared by 64-bit codes of shingles
and identified by 128-bit codes.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component; fewer words than
a shingle make one shingle; a null id takes part, and the least id that is not null names the component; rows that repeat are
exact copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallybook.llm.components import merged
from tallybook.llm.frequent import most_frequent
from tallybook.llm.observed import stored_and_counted
from tallybook.llm.shipping import ship
from tallybook.llm.words import chunks, mixed, shingle_sets, word_codes
from tallybook.sources.scratch import stored_once

#: Shingles that are put last in the order, at most, and the count from which one is.
HEAVY = 1 << 17
HEAVY_COUNT = 8
ROUNDS = 3
#: Hubs that a group of equal lists may have in a round.
HUBS = 4
FLAG_WORDS = 32
#: Members of a list that one task gets in the last join, about.
LIST = 1000
#: Keys of texts that are broadcast at most, 24 bytes each.
KEYS = 2_000_000
_PENDING = 3_000_000
_U = np.uint64


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, in order of their codes."""
    for _, _, raw, offsets in chunks(texts):
        codes, bounds = word_codes(raw, offsets)
        yield from shingle_sets(codes, bounds, size)


def _heavy(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, waiting, pending = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

        def merged(keys, n, waiting):
            every = np.concatenate([keys, *waiting])
            found, back = np.unique(every, return_inverse=True)
            weight = np.concatenate([n, np.ones(len(every) - len(n), np.int64)])
            return found, np.bincount(back, weights=weight, minlength=len(found)).astype(np.int64)

        for batch in batches:
            for s in _sets(batch.column(0), size):
                waiting.append(s)
                pending += len(s)
                if pending > _PENDING:
                    keys, n = merged(keys, n, waiting)
                    keys, n, waiting, pending = keys[n > 1], n[n > 1], [], 0
        keys, n = merged(keys, n, waiting)
        keep = n > 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(n[keep])], ["shingle", "n"])

    return run


def heavy_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order of their codes, and the rank of each by count, from 1."""
    counts = docs.select(F.col(text).cast("string")).mapInArrow(_heavy(size), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = stored_once(counts.where(F.col("n") >= HEAVY_COUNT), "join-heavy")
    found = most_frequent(counts, "n", HEAVY)
    codes, n = found["shingle"].to_numpy().view(_U), found["n"].to_numpy()
    rank = np.empty(len(codes), np.int64)
    rank[np.lexsort((codes, n))] = 1 + np.arange(len(codes))
    order = np.argsort(codes)
    return codes[order], rank[order]


def _identity(codes: np.ndarray) -> tuple[int, int]:
    """A 128-bit code of a set."""
    parts = (mixed(codes).sum(dtype=_U), mixed(codes ^ _U(0xD6E8FEB86659FD93)).sum(dtype=_U))
    return tuple(np.array(parts, _U).view(np.int64).tolist())


def _flags(codes: np.ndarray) -> np.ndarray:
    """A bitmap of a set: each shingle turns one of ``64 * FLAG_WORDS`` flags over, so that sets of any size stay apart."""
    bits = np.bincount((codes >> _U(53)).astype(np.int64), minlength=64 * FLAG_WORDS).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(_U)


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def _prefixes(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(row, id, text_key, n, set code, prefix code, prefix) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(heavy_shingles(docs, text, size))
    cut = docs.select(F.col(key).alias("id"), text_key(key, text).alias("text_key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = shared.value
        for batch in batches:
            n, k1, k2, g1, g2, prefixes, flags = [], [], [], [], [], [], []
            for s in _sets(batch.column(2), size):
                if len(heavy) and len(s):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    place = np.where(heavy[at] == s, rank[at], 0)
                    ordered = s[np.argsort(place, kind="stable")] if place.any() else s
                else:
                    ordered = s
                prefix = ordered[: prefix_length(len(s), percent)]
                for out, value in zip((k1, k2, g1, g2), (*_identity(s), *_identity(prefix)), strict=True):
                    out.append(value)
                n.append(len(s))
                prefixes.append(prefix.view(np.int64))
                flags.append(_flags(s).view(np.int64))
            lengths = np.append(0, np.cumsum([len(p) for p in prefixes], dtype=np.int64)).astype(np.int32)
            cells = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            longs = [pa.array(x, pa.int64()) for x in (n, k1, k2, g1, g2)]
            every = np.concatenate(flags) if flags else np.zeros(0, np.int64)
            starts = np.arange(len(flags) + 1, dtype=np.int32) * FLAG_WORDS
            lists = [pa.ListArray.from_arrays(pa.array(a), pa.array(b)) for a, b in ((lengths, cells), (starts, every))]
            names = ["id", "text_key", "n", "k1", "k2", "g1", "g2", "prefix", "flags"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *longs, *lists], names)

    kind = cut.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_key bigint, n bigint, k1 bigint, k2 bigint, g1 bigint, g2 bigint, prefix array<bigint>, flags array<bigint>"
    return stored_once(cut.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "join-prefixes")


def text_key(key: str, text: str) -> Column:
    """The same for rows of the same id and text."""
    return F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text))


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time: the sets of long texts are large.
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.view(np.int64) for s in _sets(part.column(2), size)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.list_(pa.int64()))], ["a", "b", "whole"])

    return run


def _apart(x: str, y: str) -> Column:
    """Flags in which two sets differ."""
    return reduce(lambda s, c: s + c, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(FLAG_WORDS)])


def _fit(percent: int, a: str, b: str) -> Column:
    """Whether sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _near(percent: int, apart: Column, a: str, b: str) -> Column:
    """Whether the flags that differ allow the similarity."""
    return (100 + percent) * apart <= (100 - percent) * (F.col(a) + F.col(b))


def _first(percent: int, a: str, b: str) -> Column:
    """Whether two sets can be similar if the token at their places ``a_p`` and ``b_p`` is the first that they share: what both have
    from there on bounds what they share. Similar sets meet at their first common token at least."""
    rest = F.least(F.col(f"{a}_n") - F.col(f"{a}_p"), F.col(f"{b}_n") - F.col(f"{b}_p"))
    return (100 + percent) * rest >= percent * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def _verified(pairs: DataFrame, n: int, keys: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``n`` pairs (a, b) whose whole sets are similar enough. ``keys`` has the text key of every member."""
    few = n <= KEYS

    def sets(side: DataFrame, of: str) -> DataFrame:
        wanted = side.join(keys.select(F.col("e").alias(of), "text_key"), of).select("text_key", "a", "b")
        met = texts.join(F.broadcast(wanted) if few else wanted, "text_key").select("a", "b", "text")
        return met.mapInArrow(_whole_sets(size), "a bigint, b bigint, whole array<bigint>")

    left = sets(pairs, "a").select("a", "b", F.col("whole").alias("x"))
    right = sets(pairs.select("b").distinct().withColumn("a", F.lit(0).cast("long")), "b").select("b", F.col("whole").alias("y"))
    joined = left.join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return joined.where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b").distinct()


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: id, text_key, n_shingles, component_id."""
    ship(docs.sparkSession)
    rows = _prefixes(docs, key, text, size, percent)
    full = rows.where("n > 0")
    group = ["n", "g1", "g2"]
    # Only groups are posted; in a list, neighbours by size tell whether a group has any partner of fit size.
    posted = full.groupBy(*group).agg(F.min("row").alias("g"), F.first("prefix").alias("prefix")).select("g", "n", F.posexplode("prefix").alias("p", "token"))
    by_size = Window.partitionBy("token").orderBy("n", "g")
    shared = (
        posted.withColumn("smaller", F.lag("n").over(by_size))
        .withColumn("larger", F.lead("n").over(by_size))
        .where((100 * F.col("smaller") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("larger")))
        .select("g", "token", "p")
    )
    groups = full.groupBy(*group).agg(
        F.min("row").alias("g"), ((F.min("k1") < F.max("k1")) | (F.min("k2") < F.max("k2"))).alias("several")
    )
    members = full.groupBy(*group, "k1", "k2").agg(F.min(F.struct("row", "text_key")).alias("m"))
    members = stored_once(
        members.select(*group, "k1", "k2", F.col("m.row").alias("e"), F.col("m.text_key").alias("text_key"))
        .join(groups, group)
        .select("k1", "k2", "n", "e", "text_key", "g", "several"),
        "join-members",
    )
    lists = shared.join(members.select("g", "e", "n"), "g").select("token", "e", "n", "p")
    inner = members.where("several").select(F.xxhash64(F.lit("group"), "g").alias("token"), "e", "n", F.lit(0).alias("p"))
    lists = stored_once(lists.union(inner), "join-lists")
    texts = docs.select(text_key(key, text).alias("text_key"), F.col(text).cast("string").alias("text"))
    keys, flags = members.select("e", "text_key"), rows.select(F.col("row").alias("e"), "flags")
    side = lambda x: flags.select(F.col("e").alias(x), F.col("flags").alias(f"{x}_flags"))

    roots: DataFrame | None = None
    for turn in range(rounds + 1):
        now = lists.withColumn("c", F.col("e"))
        if roots is not None:
            now = lists.join(roots, lists["e"] == roots["node"], "left").select("token", "e", "n", "p", F.coalesce("root", "e").alias("c"))
            spread = now.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
            now, (left, _) = stored_and_counted(now.join(spread, "token", "left_semi"), "join-open")
            if not left:
                break
        side_a = [F.col(c).alias(f"a{c_}") for c, c_ in (("e", ""), ("n", "_n"), ("p", "_p"), ("c", "_c"))]
        every = now.select("token", *side_a)
        if turn < rounds:
            hub = F.min_by(F.struct("e", "n", "p", "c"), F.xxhash64("e", F.pmod("token", F.lit(HUBS)), F.lit(turn))).alias("h")
            some = now.groupBy("token").agg(hub)
            some = some.select("token", F.col("h.e").alias("b"), F.col("h.n").alias("b_n"), F.col("h.p").alias("b_p"), F.col("h.c").alias("b_c"))
            met = every.join(some, "token").where((F.col("a_c") != F.col("b_c")) & _fit(percent, "a_n", "b_n") & _first(percent, "a", "b"))
            met = met.select("a", "a_n", "b", "b_n").distinct().join(side("a"), "a").join(side("b"), "b")
            met = met.withColumn("apart", _apart("a_flags", "b_flags")).where(_near(percent, F.col("apart"), "a_n", "b_n"))
            pairs = met.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
        else:
            # The rest: members outside the largest component of their list. The bounds are part of the join, and the members of a
            # long list are dealt to several tasks, each of which gets all of those outside.
            most = now.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token")
            most = most.agg(F.max_by("c", F.struct("k", "c")).alias("largest"), (1 + F.expr(f"sum(k) DIV {LIST}")).cast("int").alias("deals"))
            every = every.join(side("a"), "a").join(most, "token")
            x = every.withColumn("deal", F.pmod(F.hash("a"), F.col("deals"))).alias("x")
            some = every.where("a_c <> largest").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
            y = some.select("token", "deal", *[F.col(c).alias(f"b{c[1:]}") for c in ("a", "a_n", "a_p", "a_c", "a_flags")]).alias("y")
            bounds = (F.col("a_c") != F.col("b_c")) & _fit(percent, "a_n", "b_n") & _first(percent, "a", "b")
            bounds = bounds & _near(percent, _apart("a_flags", "b_flags"), "a_n", "b_n")
            met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.deal") == F.col("y.deal")) & bounds)
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs, (n, _) = stored_and_counted(pairs.select("a", "b"), "join-pairs")
        roots = merged(roots, _verified(pairs, n, keys, texts, size, percent)) if n or roots is None else roots

    assert roots is not None
    own = members.select("k1", "k2", "n", "e")
    named = rows.select("id", "text_key", "n", "k1", "k2").join(own, ["k1", "k2", "n"], "left").join(roots, F.col("e") == F.col("node"), "left")
    named = stored_once(named.select("id", "text_key", "n", F.coalesce("root", "e").alias("c")), "join-named")
    least = named.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("low"))
    return named.join(least, "c", "left").select(
        "id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id")
    )


def unique(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that of the least id (of equal ids one row), and all without words."""
    found = linked(docs, key, text, size, percent)
    grouped = found.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("text_key")).alias("alone"))
    best = grouped.agg(F.min_by("text_key", F.struct(F.col("id").isNull(), "id", "text_key")).alias("text_key")).select("text_key")
    empty = found.where("n_shingles = 0").groupBy("text_key").agg(F.count("*").alias("rows")).withColumn("empty", F.lit(True))
    kept = found.join(best, "text_key", "left_semi").groupBy("text_key").agg(F.count("*").alias("rows")).withColumn("empty", F.lit(False))
    plan = stored_once(kept.union(empty), "join-kept")
    named = docs.withColumn("__key", text_key(key, text))
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = named.join(plan.where("empty OR rows = 1").select(F.col("text_key").alias("__key")), "__key", "left_semi")
    again = named.join(plan.where("NOT empty AND rows > 1").select(F.col("text_key").alias("__key")), "__key", "left_semi").dropDuplicates(["__key"])
    return once.select(*own).union(again.select(*own))
