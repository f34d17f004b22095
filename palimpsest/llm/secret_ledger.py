"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the digest of its content. The ledger
holds, for each blob ever seen, which rule versions were run on it and what they
found. An update scans only pairs of blob and rule version that the ledger
lacks: a text that returns under another path, or a history full of copies,
costs a lookup, and a changed rule runs again on old blobs alone. Findings are
then joined back to every path that has the blob.

A rule version is the rule's kind with a digest of its pattern and least length.

Only DataFrame functions are used. Matches come from one pass of a pattern; their
places follow from the lengths of the matches and of the pieces between them.
One representative text of a blob is shuffled, the others only as digests; the
join back to paths moves digests and spans, and adaptive execution splits a blob
that a third of all rows share.

Defined results: a null text is the empty text. Rows that repeat a path and text
each get the same findings. An empty table gives an empty result. Places are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `hints`: plain strings of which every text with a match has one."""

    kind: str
    pattern: str
    hints: tuple[str, ...] = ()
    #: The group that holds the value, and its least length in code points.
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        return f"{self.kind}:{hashlib.sha256(f'{self.pattern}|{self.group}|{self.least}'.encode()).hexdigest()[:12]}"


#: Fixed order: spans that start together are listed in this order. The first three are the base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (":", "="), 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", ("AKIA",)),
    # the look-behind only spares tries: a run that is long enough is matched from its start
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh",)),
)
#: Items summed by one pass; longer arrays are summed in two levels.
CHUNK = 256

SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint>"
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"


def running_sum(numbers: Column) -> Column:
    """Sums up to each item of an array of longs."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int")), lambda k: F.slice(numbers, k * CHUNK + 1, CHUNK))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    before = F.aggregate(
        F.transform(chunks, total), F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    summed = F.transform(chunks, lambda c, k: F.transform(c, lambda _, i: F.get(before, k) + total(F.slice(c, 1, i + 1))))
    return F.when(F.size(numbers) > 0, F.flatten(summed)).otherwise(F.array().cast("array<bigint>"))


def with_spans(texts: DataFrame, rules: Sequence[Rule] = RULES, wanted: str = "rules") -> DataFrame:
    """`texts` (text, and an array `wanted` of rule versions to run) with `spans` in place of text."""
    kept = [c for c in texts.columns if c != "text"]
    names = range(len(rules))

    def runs(rule: Rule) -> Column:
        out = F.array_contains(F.col(wanted), rule.version)
        if rule.hints:
            some = F.lit(False)
            for hint in rule.hints:
                some |= F.contains("text", F.lit(hint))
            out &= some
        return out

    # each step is a projection of its own, so that no pattern is run twice on a text
    none = F.array().cast("array<string>")
    step = texts.select(*texts.columns, *(F.when(runs(r), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, r in enumerate(rules)))
    step = step.select(*kept, *(f"m{i}" for i in names), *(F.when(F.size(f"m{i}") > 0, F.split("text", r.pattern, -1)).otherwise(none).alias(f"p{i}") for i, r in enumerate(rules)))
    moves = lambda i: F.zip_with(F.slice(f"p{i}", 1, F.size(f"m{i}")), f"m{i}", lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    step = step.select(*kept, *(f"m{i}" for i in names), *(moves(i).alias(f"s{i}") for i in names))
    step = step.select(*kept, *(f"m{i}" for i in names), *(running_sum(F.col(f"s{i}")).alias(f"e{i}") for i in names))

    def spans(i: int, rule: Rule) -> Column:
        def span(match: Column, stop: Column) -> Column:
            value = F.length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.least else F.lit(0)
            whole = F.struct(
                (stop - F.length(match)).alias("start"), F.lit(i).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop")
            )
            return F.when(value >= rule.least, whole)

        return F.filter(F.zip_with(f"m{i}", f"e{i}", span), lambda x: x.isNotNull())

    found = F.array_sort(F.flatten(F.array(*(spans(i, r) for i, r in enumerate(rules)))))
    return step.select(*kept, found.cast(f"array<{SPAN}>").alias("spans"))


def versions(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """`docs` with the blob of each text and the place it is found under; text is never null afterwards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blob = F.sha2(text.cast("binary"), 256)
    # rows without a path are told apart by their content
    return docs.select(F.col(path).alias("path"), text.alias("text"), blob.alias("blob")).withColumn(
        "place", F.coalesce(F.col("path").cast("string"), F.concat(F.lit("#"), "blob"))
    )


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(ledger: DataFrame, history: DataFrame, places: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows: for each blob of `places`, what its missing rule versions find.

    `history` has the texts (`versions`), `places` the same rows without them.
    """
    every = F.array(*(F.lit(r.version) for r in rules))
    one = places.groupBy("blob").agg(F.min("place").alias("place"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    due = one.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    due = due.filter(F.size("rules") > 0).select("place", "blob", "rules")
    texts = history.select("place", "blob", "text").join(due.hint("shuffle_hash"), ["place", "blob"])
    found = with_spans(texts.select("blob", "rules", "text"), rules)
    # a path that holds the same text twice is scanned twice and entered once
    return found.groupBy("blob").agg(F.max(F.struct("rules", "spans")).alias("r")).select("blob", "r.rules", "r.spans")


def update(ledger: DataFrame, docs: DataFrame, path: str = "doc_id", rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """The ledger after `docs`, and path, blob and spans of every row of `docs`.

    A ledger has one or more rows for a blob, one for each time it was scanned;
    rows of rule versions that are no longer in `rules` are kept but not told.
    """
    history = versions(docs, path)
    places = cut(history.select("path", "place", "blob"))
    after = cut(ledger.select("blob", "rules", "spans").unionByName(scan(ledger, history, places, rules)))
    return after, findings(after, places, rules)


def findings(ledger: DataFrame, places: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows of `places` (path, blob) with the spans of their blobs under the current rules."""
    current = F.array(*(F.lit(r.version) for r in rules))
    kinds = F.transform(F.filter("rules", lambda v: F.array_contains(current, v)), lambda v: F.substring_index(v, ":", 1))
    told = ledger.select("blob", F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])).alias("spans"))
    # written, so that the join can split a blob that many places share
    told = cut(told.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    return places.select("path", "blob").join(told, "blob")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """path, counts of the base kinds, digest of the base spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "path", *(of(r.kind) for r in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Spans of every row of `docs`, scanned against an empty ledger."""
    return summary(update(empty_ledger(docs.sparkSession), docs, "doc_id", rules)[1]).withColumnRenamed("path", "doc_id")
