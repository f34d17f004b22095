"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' tokens are
raked: scaled to the target of each margin in turn until all three hold. A
document is then drawn with a probability in proportion to its cell's calibrated
weight for each token, so that the drawn tokens have the target shares as far as
no cell is asked for more than it has.

Targets are shares for each value of a margin. By default they are the shares
in the corpus to the power TEMPER, which lifts the small ones. Values that the
targets do not name share what the named ones leave over, in proportion to
their tokens. The drawn tokens come to KEEP of all tokens on average.

A topic, unless the caller names a column, is one of 2^TOPIC_BITS sides of
hyperplanes on which the text's longer words fall: the same text has the same
topic everywhere, nothing is fitted.

Cells are summed before they are shuffled. Up to CELLS of them (checked) are
raked in the driver and broadcast; beyond that the same steps run as
aggregates of the cell table, with the same stop and the same halvings. Draws hash
the doc_id, so they repeat.

Raking ends when no cell moves by CLOSE, after ROUNDS at most. Targets that the
cells cannot meet together (a language that only one source has) never settle;
`margin_gap` tells the largest distance of a margin's share from its target.

Defined results: null source and language are values of their own. A text
without words has no tokens, topic 0, and its cell's probability. Rows that
repeat a doc_id are drawn together if they fall into one cell. An empty table
gives an empty result. Columns other than doc_id, text, source, lang are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches

TEMPER = 0.7
KEEP = 0.5
TOPIC_BITS = 3
#: Shortest words, in bytes, that speak for a topic.
TOPIC_WORD = 5
ROUNDS = 100
#: 64 halvings of an interval of which the answer is a quarter at least reach the last bit of a double.
HALVINGS = 64
CLOSE = 1e-9
CELLS = 200_000
SEED = 7
REMEMBERED = 300_000

MARGINS = ("source", "lang", "topic")
Targets = Mapping[str, Mapping[str | None, float]]


class Sides(dict):
    """Word to the sides of the hyperplanes it lies on, one number per pattern of bits; -1: says nothing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        side = self[word] = zlib.crc32(word.lower()) >> (32 - TOPIC_BITS) if len(word) >= TOPIC_WORD else -1
        return side


_SIGNS = np.array([[1 if p >> b & 1 else -1 for b in range(TOPIC_BITS)] for p in range(1 << TOPIC_BITS)] + [[0] * TOPIC_BITS])


def tokens_and_topic(text: bytes | None, sides: Sides) -> tuple[int, int]:
    words = (text or b"").split()
    if not words:
        return 0, 0
    votes = np.bincount([sides[w] % (len(_SIGNS)) for w in words], minlength=len(_SIGNS)) @ _SIGNS
    return len(words), int(((votes > 0) << np.arange(TOPIC_BITS)).sum())


def measured(docs: DataFrame, topic: str | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, lang, topic, tokens and `carried` of every row; `topic` names a column to take as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides()
        for batch in small_batches(batches):
            found = [tokens_and_topic(t, sides) for t in batch.column(4).to_pylist()]
            own = pa.array([str(t) for _, t in found]) if topic is None else batch.column(3)
            columns = [*batch.columns[:3], own, pa.array([n for n, _ in found], pa.int64()), *batch.columns[5:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "lang", "topic", "tokens", *carried])

    given = F.lit(None) if topic is None else F.col(topic)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", given.cast("string").alias("topic"), F.col("text").cast("binary").alias("text"), *carried
    )
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return plain.mapInArrow(run, "doc_id long, source string, lang string, topic string, tokens long" + more)


def shares(tokens: pd.Series, wanted: Mapping[str | None, float] | None, temper: float) -> pd.Series:
    """Target shares (sum 1) of the values of one margin, given their tokens."""
    have = tokens / tokens.sum()
    if wanted is None:
        out = have**temper
    else:
        named = pd.Series({k: wanted.get(k) for k in have.index}, dtype=float, index=have.index)
        rest = have[named.isna()]
        left = max(0.0, 1.0 - named.sum())
        out = named.fillna(rest / rest.sum() * left if rest.sum() > 0 else 0.0)
    return out / out.sum() if out.sum() > 0 else have


def margins_of(cells: pd.DataFrame, wanted: Targets | None = None, temper: float = TEMPER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each margin the number of each cell's value, and the target shares by that number."""
    weight = cells["tokens"].to_numpy(float)
    weight = weight / weight.sum()
    margins = []
    for name in MARGINS:
        codes, values = pd.factorize(cells[name].fillna("\0null"))
        keys = [None if v == "\0null" else v for v in values]
        held = pd.Series(np.bincount(codes, weight, len(keys)), index=pd.Index(keys, dtype=object))
        margins.append((codes, shares(held, (wanted or {}).get(name), temper).to_numpy()))
    return margins


def rake(cells: pd.DataFrame, wanted: Targets | None = None, temper: float = TEMPER) -> np.ndarray:
    """Share of each cell (source, lang, topic, tokens) such that every margin has its target; 0 where there are no tokens."""
    weight = cells["tokens"].to_numpy(float)
    weight = weight / weight.sum()
    margins = margins_of(cells, wanted, temper)
    for _ in range(ROUNDS):
        before = weight
        for codes, target in margins:
            have = np.bincount(codes, weight, len(target))
            weight = weight * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[codes]
        if np.abs(weight - before).max() < CLOSE:
            break
    return weight


def margin_gap(cells: pd.DataFrame, weight: np.ndarray, wanted: Targets | None = None, temper: float = TEMPER) -> float:
    """The largest distance of a margin's share from its target."""
    return max(float(np.abs(np.bincount(codes, weight, len(target)) - target).max()) for codes, target in margins_of(cells, wanted, temper))


def rates(tokens: np.ndarray, weight: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """Probability of each cell's documents: in proportion to weight / tokens, at most 1, `keep` of all tokens in the mean."""
    lift = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    goal, low, high = keep * tokens[lift > 0].sum(), 0.0, 1.0
    if goal <= 0:
        return np.full(len(tokens), keep)
    while (np.minimum(1, high * lift) * tokens).sum() < goal and high < 1e300:
        high *= 4
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * lift) * tokens).sum() < goal else (low, mid)
    return np.where(tokens > 0, np.minimum(1, high * lift), keep)


def rake_table(cells: DataFrame, wanted: Targets | None = None, temper: float = TEMPER, keep: float = KEEP) -> DataFrame:
    """`rake` and `rates` for a cell table of any size: each step an aggregate by one margin."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    current = cut(cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1))))
    goals = {}
    for name in MARGINS:
        held = cut(current.groupBy(name).agg(F.sum("weight").alias("have")))
        choice = (wanted or {}).get(name)
        if choice is None:
            goal = held.withColumn("goal", F.pow("have", F.lit(temper)))
        else:
            given = held.sparkSession.createDataFrame([(k, float(v)) for k, v in choice.items()], "value string, named double")
            goal = held.join(given, F.col(name).eqNullSafe(F.col("value")), "left").drop("value")
            sums = goal.agg(F.sum("named").alias("n"), F.sum(F.when(F.col("named").isNull(), F.col("have"))).alias("r")).first()
            left = max(0.0, 1.0 - (sums["n"] or 0.0))
            goal = goal.withColumn("goal", F.coalesce("named", F.col("have") / F.lit(sums["r"] or 1.0) * left))
        whole = goal.agg(F.sum("goal")).first()[0] or 0.0
        goals[name] = cut(goal.select(name, (F.col("goal") / whole if whole > 0 else F.col("have")).alias("goal")))
    for _ in range(ROUNDS):
        raked = current.withColumn("was", F.col("weight"))
        for name in MARGINS:
            have = raked.groupBy(F.col(name).alias("value")).agg(F.sum("weight").alias("have"))
            scale = have.join(goals[name], F.col("value").eqNullSafe(F.col(name))).select(
                "value", F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("scale")
            )
            raked = raked.join(scale, F.col(name).eqNullSafe(F.col("value")))
            raked = cut(raked.withColumn("weight", F.col("weight") * F.col("scale")).drop("scale", "value"))
        moved = raked.agg(F.max(F.abs(F.col("weight") - F.col("was")))).first()[0] or 0.0
        current = raked.drop("was")
        if moved < CLOSE:
            break
    gap = 0.0
    for name in MARGINS:
        have = current.groupBy(F.col(name).alias("value")).agg(F.sum("weight").alias("have"))
        met = have.join(goals[name], F.col("value").eqNullSafe(F.col(name)))
        gap = max(gap, met.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0)
    lift = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    goal = keep * (current.filter(lift > 0).agg(F.sum("tokens")).first()[0] or 0)
    low, high = 0.0, 1.0
    got = lambda x: current.agg(F.sum(F.least(F.lit(1.0), F.lit(x) * lift) * F.col("tokens"))).first()[0] or 0.0
    while goal > 0 and got(high) < goal and high < 1e300:
        high *= 4
    for _ in range(HALVINGS if goal > 0 else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if got(mid) < goal else (low, mid)
    chance = F.when((F.col("tokens") > 0) & F.lit(goal > 0), F.least(F.lit(1.0), F.lit(high) * lift)).otherwise(keep)
    return current.withColumns({"probability": chance, "margin_gap": F.lit(gap if total else 0.0)})


def drawn(doc_id, seed: int = SEED):
    """A number from 0 to 1 that hangs on the id alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame,
    wanted: Targets | None = None,
    keep: float = KEEP,
    temper: float = TEMPER,
    topic: str | None = None,
    most_cells: int = CELLS,
    seed: int = SEED,
    carried: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (share of the cell), probability, margin_gap, sampled and `carried` for every row of `docs`."""
    rows = cut(measured(docs, topic, carried))
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    if cells.count() <= most_cells:
        known = cells.toPandas().sort_values(list(MARGINS), na_position="first", ignore_index=True)
        if not len(known) or not known["tokens"].sum():
            known["weight"], known["probability"], known["margin_gap"] = 0.0, keep, 0.0
        else:
            known["weight"] = rake(known, wanted, temper)
            known["probability"] = rates(known["tokens"].to_numpy(float), known["weight"].to_numpy(), keep)
            known["margin_gap"] = margin_gap(known, known["weight"].to_numpy(), wanted, temper)
        records = [tuple(r) for r in known.astype(object).where(known.notna(), None).itertuples(index=False)]
        rated = docs.sparkSession.createDataFrame(records, "source string, lang string, topic string, tokens long, weight double, probability double, margin_gap double")
        rated = F.broadcast(rated.drop("tokens"))  # at most `most_cells` rows
    else:
        rated = cut(rake_table(cells, wanted, temper, keep)).drop("tokens")
    rated = rated.select(*(F.col(m).alias(f"cell_{m}") for m in MARGINS), "weight", "probability", "margin_gap")
    same = F.lit(True)
    for m in MARGINS:
        same &= F.col(m).eqNullSafe(F.col(f"cell_{m}"))
    return rows.join(rated, same).select(
        "doc_id", *MARGINS, "tokens", "weight", "probability", "margin_gap", (drawn(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"), *carried
    )
