"""Skew-proof building blocks: lookups, ordered scans and numbering.

A plain window over a hot group sorts that group in one task. The functions
here cut a group into ordered buckets, work inside the buckets in parallel, and
carry only one summary row per bucket across. Where a hot group is cut follows
from a sample of its rows, so buckets hold about as many rows whatever the order
columns are: dense numbers, microseconds, a few values with long ties, or text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
HOT_ROWS = 1 << 22
#: Rows of a bucket, about, and sampled rows for each of them.
ROWS = 1 << 20
SAMPLES = 8


def lookup(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join `big` to `small`, which holds at most one row per `on`.

    `big` may hold any share of its rows under one value of `on`: its rows are
    salted by `spread_by` and `small` is repeated once per salt, so a hot value
    is read by `salts` tasks. Both sides keep their rows. Spark does not count the
    repeats before it has made them, so the sides are exchanged, never broadcast.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def lookup_large(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`lookup` for a `small` side too large to repeat as a whole.

    Only values held by more than `hot_rows` rows of `big` are salted, and only
    their rows of `small` repeated, in proportion. There are at most
    |big| / `hot_rows` such values, which bounds what is broadcast. The two sides are
    exchanged: once no value is hot, Spark takes rows that `big` explodes for the few
    they come from.
    """
    keys = [F.col(f"`{c}`") for c in on]
    hot = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    )
    parts = F.coalesce("_salts", F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), parts).cast("int")
    salted = big.join(F.broadcast(hot), list(on), "left").withColumn("_salt", spread).drop("_salts")
    repeated = (
        small.join(F.broadcast(hot), list(on), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_salts")
    )
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def bucketed(df: DataFrame, part: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Add `_bucket`: buckets of a group hold about `rows` rows each, and come in the order of the columns `order`;
    null in a group that is one bucket.

    Rows are sampled by a hash of part and order, about SAMPLES for `rows`. Of a
    group's sample in order every SAMPLES-th row starts a bucket; a group with a
    smaller sample is one bucket. There are at most about |df| / `rows` such
    starts, which bounds what is broadcast.
    """
    part, at = list(part), F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    drawn = df.where(F.pmod(F.xxhash64(F.lit("bucket"), *part, *order), F.lit(max(1, rows // SAMPLES))) == 0)
    sample = drawn.groupBy(*[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(part)]).agg(F.sort_array(F.collect_list(at)).alias("_sample"))
    places = F.sequence(F.lit(SAMPLES), F.size("_sample"), F.lit(SAMPLES))
    large = sample.where(F.size("_sample") >= SAMPLES)
    starts = large.select(*[f"_p{i}" for i in range(len(part))], F.transform(places, lambda i: F.element_at("_sample", i)).alias("_starts"))
    same = F.lit(True)
    for i, c in enumerate(part):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_p{i}"))
    passed = F.size(F.filter("_starts", lambda start: start <= at))
    met = df.join(F.broadcast(starts), same, "left")
    return met.withColumn("_bucket", F.when(F.col("_starts").isNotNull(), passed)).drop("_starts", *[f"_p{i}" for i in range(len(part))])


def _carried(rows: DataFrame, summary: DataFrame, part: Sequence[str]) -> DataFrame:
    """`rows` with what `summary` says of their bucket; a null in `part` is a group of its own.

    Only the buckets of groups that are cut have something to carry, at most about
    twice as many as starts, which bounds what is broadcast.
    """
    names = {c: f"_p{i}" for i, c in enumerate(part)}
    same = F.col("_bucket") == F.col("_b")
    for c, other in names.items():
        same &= F.col(f"`{c}`").eqNullSafe(F.col(other))
    return rows.join(F.broadcast(summary.withColumnsRenamed({**names, "_bucket": "_b"})), same, "left").drop("_b", *names.values())


def ordered_scan(
    df: DataFrame,
    part: Sequence[str],
    seq: str,
    *,
    before: Mapping[str, Column] | None = None,
    upto: Mapping[str, Column] | None = None,
    ahead: Mapping[str, Column] | None = None,
    tie: Sequence[str] = (),
    rows: int = ROWS,
) -> DataFrame:
    """Add values of the neighbours of each row in the order of the
    column `seq` (and `tie`, where it is equal) inside `part`: `before` the last non-null among the rows
    before it, `upto` the same including it, `ahead` the value of the next row.

    One pass over the rows for all of them together.
    """
    before, upto, ahead = before or {}, upto or {}, ahead or {}
    last = {**before, **upto}
    staged = bucketed(df, part, [seq, *tie], rows)
    staged = staged.withColumns(
        {**{f"_v_{n}": v for n, v in last.items()}, **{f"_v_{n}": F.struct(v.alias("v")) for n, v in ahead.items()}}
    )
    place = Window.partitionBy(*part, "_bucket").orderBy(seq, *tie)
    at = F.struct(seq, *tie)
    frames = {n: place.rowsBetween(Window.unboundedPreceding, 0 if n in upto else -1) for n in last}
    local = staged.withColumns(
        {
            **{f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(frames[n]) for n in last},
            **{f"_l_{n}": F.lead(f"_v_{n}").over(place) for n in ahead},
        }
    )
    present = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), at)
    heads = staged.where(F.col("_bucket").isNotNull()).groupBy(*part, "_bucket").agg(
        *[F.max_by(f"_v_{n}", present(n)).alias(f"_h_{n}") for n in last],
        *[F.min_by(f"_v_{n}", at).alias(f"_h_{n}") for n in ahead],
    )
    buckets = Window.partitionBy(*part).orderBy("_bucket")
    earlier = buckets.rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(
        *part,
        "_bucket",
        *[F.last(f"_h_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last],
        *[F.lead(f"_h_{n}").over(buckets).alias(f"_c_{n}") for n in ahead],
    )
    joined = _carried(local, carried, part)
    found = {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in (*last, *ahead)}
    out = joined.withColumns({n: c["v"] if n in ahead else c for n, c in found.items()})
    return out.drop("_bucket", *[f"{p}{n}" for n in found for p in ("_v_", "_l_", "_c_")])


def running_last(
    df: DataFrame,
    part: Sequence[str],
    seq: str,
    values: Mapping[str, Column],
    *,
    inclusive: bool,
    tie: Sequence[str] = (),
    rows: int = ROWS,
) -> DataFrame:
    """The last non-null of each value before each row (`inclusive`: up to it)."""
    if inclusive:
        return ordered_scan(df, part, seq, upto=values, tie=tie, rows=rows)
    return ordered_scan(df, part, seq, before=values, tie=tie, rows=rows)


def number_within(
    df: DataFrame,
    part: Sequence[str],
    ordinal: str,
    out: str,
    *,
    leading: Sequence[str] = (),
    tie: Sequence[str] = (),
    rows: int = ROWS,
) -> DataFrame:
    """Number rows 1..n inside `part`, ordered by `leading`, `ordinal`, `tie`."""
    order = [*leading, ordinal, *tie]
    staged = bucketed(df, part, order, rows)
    near = Window.partitionBy(*part, "_bucket").orderBy(*order)
    local = staged.withColumn("_near", F.row_number().over(near))
    sizes = staged.where(F.col("_bucket").isNotNull()).groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    far = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, "_bucket", F.sum("_size").over(far).alias("_before"))
    joined = _carried(local, offsets, part)
    return joined.withColumn(out, (F.col("_near") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_bucket", "_near", "_before")
