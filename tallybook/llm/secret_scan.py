"""Secret scans weighed by corpus-wide ownership.

Every text is scanned once for candidates: assignments to secret-like names, access keys, long hexadecimal runs
(together the base spans) and other long tokens that mix capitals, small letters and digits. The hash of each
candidate is then counted over the corpus: in how many repositories and by how many owners it occurs. A hash of more
than ``max_owners`` owners or ``max_repositories`` repositories is a widely copied example; the others are specific to
their owner and look live. A long token becomes a span (kind ``owned``) only if it is owner-specific; base spans stay
whatever the verdict, which says which of them to mask.

(hash, owner, repository) is made distinct inside the map tasks, so a string that a third of all rows hold is one
row per task. Only built-in functions are used. Positions are code points, the end is exclusive.

Defined cases: a null text is empty and has no spans; a null owner or repository is an owner or repository of its own; rows
that repeat get the same result; a token inside a base span is no span of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.sources.scratch import stored_once

#: The base patterns by kind, in the order in which kinds are listed, and least lengths. Looking
#: behind spares the search from starting anew inside a run that was too short.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{16,}", "owned": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"}
BASE = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16, "owned": 24}
MAX_OWNERS = 2
MAX_REPOSITORIES = 3
_SPAN = "array<struct<start: int, rank: int, end: int, kind: string, hash: bigint>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _secret_part(kind: str, match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match


def spans_of(kind: str, text: Column) -> Column:
    """All spans of a kind: the pieces between leftmost matches give the places of the matches."""
    pattern = PATTERNS[kind]

    def placed(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        walked = F.aggregate(
            F.arrays_zip(pieces.alias("piece"), matches.alias("match")),
            F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found")),
            lambda s, x: F.struct(
                (s["at"] + F.length(x["piece"]) + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
                F.when(
                    F.length(_secret_part(kind, x["match"])) >= LEAST[kind],
                    F.concat(s["found"], F.array(_span(kind, s["at"] + F.length(x["piece"]), x["match"]))),
                ).otherwise(s["found"]).alias("found"),
            ),
        )
        return walked["found"]

    none = F.array().cast(_SPAN)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "owned":
        mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
        # Tokens that lack a character class are no candidates.
        spans = let(
            F.struct(let(matches, placed).alias("all"), F.transform(matches, lambda m: F.when(mixed(m), F.xxhash64(m))).alias("good")),
            lambda x: F.filter(x["all"], lambda s: F.coalesce(F.array_contains(x["good"], s["hash"]), F.lit(False))),
        )
    else:
        spans = let(matches, placed)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _span(kind: str, start: Column, match: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(list(PATTERNS).index(kind)).alias("rank"),
        (start + F.length(match)).cast("int").alias("end"),
        F.lit(kind).alias("kind"),
        F.xxhash64(_secret_part(kind, match)).alias("hash"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: tuple[str, ...] = ("source",),
    repository: tuple[str, ...] = ("source", "lang"),
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document row: doc_id, row_key, base and all spans with ``live`` and ``n_owners`` for each."""
    whole = F.coalesce(F.col("__text"), F.lit(""))
    name = lambda columns: F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])
    taken = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("__text"), name(owner).alias("owner"), name(repository).alias("repository"), row_key(key, text).alias("row_key")
    )
    base = F.array_sort(F.concat(*[spans_of(k, whole) for k in BASE]))
    found = taken.withColumn("base", base).withColumn("tokens", spans_of("owned", whole)).drop("__text")
    inside = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    stored = stored_once(found.withColumn("tokens", F.filter("tokens", lambda t: ~inside(t))), "secret-spans")
    held = stored.where((F.size("base") > 0) | (F.size("tokens") > 0))
    each = held.select("owner", "repository", F.explode(F.array_distinct(F.transform(F.concat("base", "tokens"), lambda s: s["hash"]))).alias("hash"))
    spread = (
        each.distinct()
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("hash")
        .agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))
        .withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    )
    one = held.groupBy("row_key").agg(F.first("base").alias("base"), F.first("tokens").alias("tokens"))
    weighed = (
        one.select("row_key", F.explode(F.concat("base", "tokens")).alias("s"))
        .withColumn("hash", F.col("s.hash"))
        .join(spread, "hash")
        .groupBy("row_key")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("s.start", "s.rank", "s.end", "s.kind", "live", "n_owners", "n_repositories"))
            ).alias("weighed")
        )
    )
    r, w = stored.alias("r"), weighed.alias("w")
    spans = F.coalesce("w.weighed", F.array().cast(weighed.schema["weighed"].dataType))
    kept = F.filter(spans, lambda s: (s["rank"] < len(BASE)) | s["live"])
    return r.join(w, F.col("r.row_key") == F.col("w.row_key"), "left").select("r.doc_id", "r.row_key", "r.base", kept.alias("spans"))


def row_key(key: str, text: str) -> Column:
    """The same for rows of the same id and text; such rows have the same spans."""
    part = F.concat_ws(":", F.col(key).cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.md5(part)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``scan``."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select(
        "doc_id", *[n(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), live.alias("n_live")
    )


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]", **how) -> DataFrame:
    """The documents with owner-specific secrets masked; widely copied examples stay. All columns are kept."""
    found = scan(docs, key, text, **how)
    live = (
        found.groupBy("row_key")
        .agg(F.first(F.filter("spans", lambda s: s["live"])).alias("live"))
        .where(F.size("live") > 0)
    )
    d, f = docs.withColumn("__key", row_key(key, text)).alias("d"), live.alias("f")
    # Spans may overlap: each masks what lies beyond the end of those before it.
    walked = F.aggregate(
        "f.live",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(
                x["start"] >= s["at"],
                F.concat(s["out"], F.substring(F.col(f"d.`{text}`"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask)),
            ).otherwise(s["out"]).alias("out"),
        ),
    )
    clean = let(walked, lambda w: F.concat(w["out"], F.substring(F.col(f"d.`{text}`"), w["at"] + 1, F.length(F.col(f"d.`{text}`")))))
    new = F.when(F.col("f.live").isNotNull(), clean).otherwise(F.col(f"d.`{text}`")).alias(text)
    return d.join(f, F.col("d.__key") == F.col("f.row_key"), "left").select(*[new if c == text else F.col(f"d.`{c}`") for c in docs.columns])
