"""What the deletion of parent rows does to the tables that refer to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.cells import key_text
from palimpsest.operators.integrity import ForeignKey
from palimpsest.operators.spread import lookup_large
from palimpsest.session import cut

EFFECTS = {
    "cascade": "delete",
    "set_null": "set_null",
    "set_default": "set_default",
    "restrict": "blocked",
    "no_action": "blocked_at_end",  # unless the row is gone by then
}
BY = "struct<via:string,columns:string>"
OUT = "table string, key string, effect string, via string, columns string, depth int"


def referential_effects(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    fks: Sequence[ForeignKey],
    deleted: Mapping[str, DataFrame],
) -> DataFrame:
    """`(table, key, effect, via, columns, depth)` for the keys in `deleted`.

    `via` and `columns` name the reference an effect belongs to: the parent and
    the referring columns. `restrict` blocks at once; `no_action` is looked at
    when all deletes are known and blocks only if the referring row is left.

    Deletes travel along the foreign keys in rounds. A reference of a table to
    itself is followed to all its levels in one round, by pointer doubling, so
    rounds grow with the number of tables on a path and not with the depth of a
    tree. A row is deleted once even where references form a cycle; `depth` is
    the least number of references from the first deletion: a row that is
    reached again on a shorter way goes on once more. A set-null, set-default or
    blocked row does not travel.
    """
    rows = dict(tables)
    known = {t: df.select(*keys[t]).dropDuplicates().withColumns({"depth": F.lit(0).cast("long"), "by": F.lit(None).cast(BY)}) for t, df in deleted.items()}
    gone = {t: cut(df) for t, df in known.items()}
    frontier = dict(gone)
    cascades = [fk for fk in fks if EFFECTS[fk.on_delete] == "delete"]
    chains = {i: _chain(rows[fk.table], keys[fk.table], fk) for i, fk in enumerate(cascades) if fk.table == fk.parent}
    while frontier:
        reached: dict[str, list[DataFrame]] = {}
        for i, fk in enumerate(cascades):
            if fk.parent not in frontier:
                continue
            key = list(keys[fk.table])
            if chains.get(i) is not None:
                # what this reference has found goes on along the others only
                starts = frontier[fk.table].where(~F.col("by").eqNullSafe(_reference(fk)))
                if starts.isEmpty():
                    continue
                found = _below(chains[i], starts, key)
            else:
                found = _children(rows, keys, fk, frontier[fk.parent])
            reached.setdefault(fk.table, []).append(found.select(*key, "depth", _reference(fk).alias("by")))
        frontier = {}
        for table, found in reached.items():
            key = list(keys[table])
            best = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min(F.struct("depth", "by")).alias("b")).select(*key, "b.*")
            if table in gone:
                had = gone[table].select(*key, F.col("depth").alias("_had"))
                best = best.join(had, key, "left").where(F.col("_had").isNull() | (F.col("depth") < F.col("_had"))).drop("_had")
            fresh = cut(best)
            if fresh.isEmpty():
                continue
            frontier[table] = fresh
            gone[table] = cut(gone[table].join(fresh, key, "left_anti").unionByName(fresh)) if table in gone else fresh
    effects = []
    for table, df in gone.items():
        # of the references that delete a row at its depth the first is told
        key, found = list(keys[table]), df.where("depth > 0").select(*keys[table], "depth")
        by = [fk for fk in cascades if fk.table == table and fk.parent in gone]
        if len(by) == 1:
            effects.append(_effect(found.withColumn("by", _reference(by[0])), table, key, "delete"))
        elif by:
            ways = [_children(rows, keys, fk, gone[fk.parent]).withColumn("by", _reference(fk)) for fk in by]
            told = reduce(DataFrame.unionByName, ways).join(found, [*key, "depth"]).groupBy(*key, "depth").agg(F.min("by").alias("by"))
            effects.append(_effect(told, table, key, "delete"))
    for fk in fks:
        if EFFECTS[fk.on_delete] != "delete" and fk.parent in gone:
            hit = _children(rows, keys, fk, gone[fk.parent]).withColumn("by", _reference(fk))
            effects.append(_effect(hit, fk.table, list(keys[fk.table]), EFFECTS[fk.on_delete]))
    if not effects:
        return next(iter(tables.values())).sparkSession.createDataFrame([], OUT)
    # A row that is deleted by one reference needs no other effect.
    return _deletes_win(reduce(DataFrame.unionByName, effects))


def _children(rows: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], fk: ForeignKey, parents: DataFrame) -> DataFrame:
    """`(key…, depth)` of the rows that refer to `parents` (key…, depth)."""
    met = rows[fk.parent].join(parents.select(*keys[fk.parent], "depth"), list(keys[fk.parent]))
    values = met.select(*[F.col(r).alias(c) for c, r in zip(fk.cols, fk.ref_cols)], "depth")
    values = values.groupBy(*fk.cols).agg((F.min("depth") + 1).alias("depth"))
    narrow = rows[fk.table].select(*dict.fromkeys([*keys[fk.table], *fk.cols]))
    return lookup_large(narrow, values, fk.cols, keys[fk.table]).select(*keys[fk.table], "depth")


def _chain(df: DataFrame, key: Sequence[str], fk: ForeignKey) -> DataFrame | None:
    """`(id, up)`: every row and the one it refers to in its own table; None if
    several rows hold one referred value, which leaves no single way up."""
    parents = df.select(F.struct(*key).alias("up"), *[F.col(r).alias(c) for c, r in zip(fk.cols, fk.ref_cols)])
    if not parents.dropna(subset=list(fk.cols)).groupBy(*fk.cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    narrow = df.select(F.struct(*key).alias("id"), *fk.cols)
    return cut(lookup_large(narrow, parents, fk.cols, ["id"], "left").select("id", "up"))


def _below(chain: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """`(key…, depth)` of everything below `starts` (key…, depth).

    After k rounds a row knows the best depth that its nearest 2^k rows upwards
    give it, and the row after these.
    """
    own = starts.select(F.struct(*key).alias("id"), F.col("depth").alias("best"))
    state, step = cut(chain.join(own, "id", "left")), 1
    most = max(1, state.count())
    while step <= 2 * most and not state.where("up is not null").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        moved = lookup_large(state.where("up is not null"), above, ["up"], ["id"])
        moved = moved.select("id", F.col("_up").alias("up"), F.least("best", F.col("_best") + step).alias("best"))
        state, step = cut(state.where("up is null").unionByName(moved)), 2 * step
    met = state.where("best is not null").join(own.withColumnRenamed("best", "_own"), "id", "left")
    return met.where("_own is null or best < _own").select(*[F.col(f"id.{k}").alias(k) for k in key], F.col("best").alias("depth"))


def _reference(fk: ForeignKey) -> Column:
    return F.struct(F.lit(fk.parent).alias("via"), F.lit(",".join(fk.cols)).alias("columns"))


def _effect(hit: DataFrame, table: str, key: list[str], effect: str) -> DataFrame:
    return hit.select(
        F.lit(table).alias("table"),
        key_text(key, hit.schema).alias("key"),
        F.lit(effect).alias("effect"),
        "by.via",
        "by.columns",
        F.col("depth").cast("int").alias("depth"),
    )


def _deletes_win(effects: DataFrame) -> DataFrame:
    deletes = effects.where(F.col("effect") == "delete")
    others = effects.where(~F.col("effect").isin("delete", "blocked"))
    kept = others.join(deletes.select("table", "key"), ["table", "key"], "left_anti")
    kept = kept.withColumn("effect", F.when(F.col("effect") == "blocked_at_end", "blocked").otherwise(F.col("effect")))
    kept = kept.select(*deletes.columns)
    return deletes.unionByName(kept).unionByName(effects.where(F.col("effect") == "blocked"))
