"""Find again the objects of a schema that was loaded without ids.

Equal names are the same object. Anything less is proposed with a score and
never applied without a decision, keyed by the id on the head side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.similarity import COLUMN_THRESHOLD, PRESELECT, TABLE_THRESHOLD, column_similarity, confidence
from palimpsest.operators.catalog import PROJECT, SCOPE, TABLE, Catalog, plain_columns
from palimpsest.operators.classes import Classes, serve
from palimpsest.operators.spread import number_within
from palimpsest.session import cut

PROPOSAL = [PROJECT, "kind", "table", "old_id", "old_name", "new_id", "new_name", "confidence", "preselected", "contested"]


def _firsts(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The first object of each name; of two with one name only that one can be met."""
    full = F.struct(*df.columns)
    return df.groupBy(*scope, "name").agg(F.min_by(full, F.struct(*order)).alias("r")).select("r.*")


def match_tables(head: DataFrame, new: DataFrame) -> DataFrame:
    """`(project_id, old_id, new_id)` of tables with equal names."""
    old = _firsts(head, [PROJECT], ["ordinal", TABLE]).select(PROJECT, "name", F.col(TABLE).alias("old_id"))
    fresh = _firsts(new, [PROJECT], ["ordinal", TABLE]).select(PROJECT, "name", F.col(TABLE).alias("new_id"))
    return old.join(fresh, [PROJECT, "name"]).select(PROJECT, "old_id", "new_id")


def match_columns(head: DataFrame, new: DataFrame, tables: DataFrame) -> DataFrame:
    """`(project_id, old_table, new_table, old_id, new_id)` of columns with equal
    names in matched tables."""
    pairs = tables.select(PROJECT, F.col("old_id").alias("old_table"), F.col("new_id").alias("new_table"))
    old = _firsts(head, SCOPE, ["position", "column_id"]).select(
        PROJECT, F.col(TABLE).alias("old_table"), "name", F.col("column_id").alias("old_id")
    )
    fresh = _firsts(new, SCOPE, ["position", "column_id"]).select(
        PROJECT, F.col(TABLE).alias("new_table"), "name", F.col("column_id").alias("new_id")
    )
    return (
        old.join(pairs, [PROJECT, "old_table"])
        .join(fresh, [PROJECT, "new_table", "name"])
        .select(PROJECT, "old_table", "new_table", "old_id", "new_id")
    )


def match_by_name(head: Catalog, new: Catalog) -> tuple[DataFrame, DataFrame]:
    """Table and column matches by equal names."""
    tables = match_tables(head.tables, new.tables)
    return tables, match_columns(head.columns, new.columns, tables)


def _tokens(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """`(project_id, table_id, token, n)`: distinct (name, type) of the first
    column of each name, and the number of columns of the table."""
    # as many rows as tables and columns: exchanged, whatever the files' size promises
    inside = columns.join(tables.select(*SCOPE).hint("merge"), SCOPE, "left_semi").hint("merge")
    sizes = inside.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))
    first = _firsts(inside, SCOPE, ["position", "column_id"]).select(*SCOPE, F.struct("name", "type").alias("token"))
    return first.join(sizes, SCOPE)


def table_classes(head: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(tables of head with their class a, tables of new with their class b,
    (project_id, a, b, score) of the classes that reach the threshold)`; inputs
    are columns as `(…, name, type, position)`.

    Tables alike in all columns are one class and score alike. score = 2 ×
    shared (name, type) / (columns of both). A pair that reaches the threshold
    shares at least a quarter of each side, so it also shares a token among the
    rarest three quarters plus one of each: only those are joined (prefix
    filter), and a token that every table has, such as an id, joins nothing.
    """
    a = _tokens(head, head.select(*SCOPE).distinct())
    b = _tokens(new, new.select(*SCOPE).distinct())
    a, b = cut(_alike(a)), cut(_alike(b))
    sets_a, sets_b = _sets(a), _sets(b)
    both = a.select(PROJECT, "token").unionByName(b.select(PROJECT, "token"))
    frequency = both.groupBy(PROJECT, "token").agg(F.count(F.lit(1)).alias("f"))
    pa, pb = _prefix(sets_a, frequency, "a"), _prefix(sets_b, frequency, "b")
    # as many rows as classes have tokens: exchanged, like those of `_tokens`
    pairs = pa.join(pb.hint("merge"), [PROJECT, "token"]).select(PROJECT, "a", "b").distinct()
    left = sets_a.select(PROJECT, F.col("like").alias("a"), "token", F.col("n").alias("n_a"))
    right = sets_b.select(PROJECT, F.col("like").alias("b"), "token", F.col("n").alias("n_b"))
    shared = pairs.join(left, [PROJECT, "a"]).join(right, [PROJECT, "b", "token"]).groupBy(PROJECT, "a", "b")
    scored = shared.agg(F.count(F.lit(1)).alias("m"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    score = 2 * F.col("m") / (F.col("n_a") + F.col("n_b"))
    good = scored.select(PROJECT, "a", "b", score.alias("score")).where(F.col("score") >= TABLE_THRESHOLD)
    old = a.select(PROJECT, F.col(TABLE).alias("old_id"), F.col("like").alias("a")).distinct()
    fresh = b.select(PROJECT, F.col(TABLE).alias("new_id"), F.col("like").alias("b")).distinct()
    return old, fresh, good


def table_similarity(head: DataFrame, new: DataFrame) -> DataFrame:
    """`(project_id, old_id, new_id, score)` for every pair of tables that
    reaches the threshold. Its rows are pairs: matching itself goes by classes."""
    old, fresh, good = table_classes(head, new)
    return good.join(old, [PROJECT, "a"]).join(fresh, [PROJECT, "b"]).select(PROJECT, "old_id", "new_id", "score")


def _alike(tokens: DataFrame) -> DataFrame:
    """Add `like`: one fingerprint for all tables with the same columns. A table
    has as many tokens as columns, which is what bounds the list."""
    whole = tokens.groupBy(*SCOPE).agg(F.sort_array(F.collect_list("token")).alias("_all"), F.first("n").alias("_n"))
    like = F.sha2(F.to_json(F.struct("_n", "_all")), 256)
    return tokens.join(whole.select(*SCOPE, like.alias("like")), SCOPE)


def _sets(tokens: DataFrame) -> DataFrame:
    return tokens.select(PROJECT, "like", "token", "n").distinct()


def _prefix(sets: DataFrame, frequency: DataFrame, out: str) -> DataFrame:
    ranked = Window.partitionBy(PROJECT, "like").orderBy("f", "token")
    placed = sets.join(frequency.hint("merge"), [PROJECT, "token"]).withColumn("rank", F.row_number().over(ranked))
    total = F.count(F.lit(1)).over(Window.partitionBy(PROJECT, "like"))
    needed = F.ceil(F.col("n") * (TABLE_THRESHOLD / (2 - TABLE_THRESHOLD)) - 1e-9)
    kept = placed.withColumn("total", total).where(F.col("rank") <= F.col("total") - needed + 1)
    return kept.select(PROJECT, "token", F.col("like").alias(out))


def table_candidates(head: Catalog, new: Catalog, matched: DataFrame) -> Classes:
    """Tables that found no equal name, by class."""
    lost = head.tables.join(matched.select(PROJECT, F.col("old_id").alias(TABLE)), SCOPE, "left_anti")
    fresh = new.tables.join(matched.select(PROJECT, F.col("new_id").alias(TABLE)), SCOPE, "left_anti")
    cols = lambda cat, t: plain_columns(cat.columns).join(t.select(*SCOPE), SCOPE, "left_semi")
    a, b, edges = table_classes(cols(head, lost), cols(new, fresh))
    old = lost.select(PROJECT, F.col(TABLE).alias("old_id"), F.col("name").alias("old_name"), F.col("ordinal").alias("old_order"))
    nxt = fresh.select(PROJECT, F.col(TABLE).alias("new_id"), F.col("name").alias("new_name"), F.col("ordinal").alias("new_order"))
    return Classes(cut(old.join(a, [PROJECT, "old_id"])), cut(nxt.join(b, [PROJECT, "new_id"])), cut(edges))


def column_candidates(head: Catalog, new: Catalog, tables: DataFrame, matched: DataFrame) -> DataFrame:
    """Candidates for columns of matched tables that found no equal name.

    A score of one half needs an equal base type (position and name alone stay
    below it), so base type joins the key and no candidate is lost. Pairs stay
    inside one table and one base type.
    """
    split = lambda df: df.withColumn("base", F.substring_index("type", "(", 1))
    old_all, new_all = split(plain_columns(head.columns)), split(plain_columns(new.columns))
    names_old = old_all.select(PROJECT, F.col(TABLE).alias("old_table"), "name").distinct()
    pairs = tables.select(PROJECT, F.col("old_id").alias("old_table"), F.col("new_id").alias("new_table"))
    # A head column is lost when its name is gone; a new one is free when no head column took it.
    names_new = new_all.select(PROJECT, F.col(TABLE).alias("new_table"), "name").distinct()
    old = old_all.withColumnRenamed(TABLE, "old_table").join(pairs, [PROJECT, "old_table"])
    lost = old.join(names_new, [PROJECT, "new_table", "name"], "left_anti")
    taken = matched.select(PROJECT, "new_table", F.col("new_id").alias("column_id"))
    fresh = new_all.withColumnRenamed(TABLE, "new_table").join(pairs, [PROJECT, "new_table"])
    free = fresh.join(taken, [PROJECT, "new_table", "column_id"], "left_anti")
    rename = lambda df, p: df.select(
        PROJECT,
        "old_table",
        "new_table",
        "base",
        F.col("column_id").alias(f"{p}_id"),
        F.col("name").alias(f"{p}_name"),
        F.col("type").alias(f"{p}_type"),
        F.col("position").alias(f"{p}_order"),
    )
    met = rename(lost, "old").join(rename(free, "new").drop("old_table"), [PROJECT, "new_table", "base"])
    score = column_similarity(
        F.col("old_name"),
        F.col("new_name"),
        F.col("base"),
        F.col("base"),
        F.col("old_type"),
        F.col("new_type"),
        F.col("old_order"),
        F.col("new_order"),
    )
    return met.withColumn("score", score).where(F.col("score") >= COLUMN_THRESHOLD)


def _best(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Highest score, then first in the order of the new side."""
    rest = [c for c in candidates.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct("score", -F.col("new_order"), F.col("new_id")))
    return candidates.groupBy(*by).agg(top.alias("r")).select(*by, "r.*")


def assign(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """One new object for one head object, in head order.

    Rounds of offers: every head object asks for its best remaining candidate,
    a candidate holds the lowest head order that asked, and everyone behind that
    holder stops asking for it. The outcome is that of serving the head objects
    one after another.
    """
    alive = cut(candidates)
    while True:
        asked = _best(alive, [*scope, "old_id"])
        held = asked.groupBy(*scope, "new_id").agg(F.min(F.struct("old_order", "old_id")).alias("holder"))
        judged = cut(alive.join(held, [*scope, "new_id"], "left"))
        behind = F.col("holder").isNotNull() & (F.struct("old_order", "old_id") > F.col("holder"))
        left = judged.where(~behind).drop("holder")
        if judged.where(behind).isEmpty():
            return _best(left, [*scope, "old_id"])
        alive = cut(left)


def _answers(decisions: DataFrame | None, kind: str) -> DataFrame | None:
    """One answer for each object; of two the acceptance counts."""
    if decisions is None:
        return None
    mine = decisions.where(F.col("kind") == kind) if "kind" in decisions.columns else decisions
    return mine.groupBy(*[c for c in (PROJECT, "old_id") if c in decisions.columns]).agg(F.max("rename").alias("rename"))


def _decided(candidates: DataFrame, answers: DataFrame | None, scope: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """`(accepted assignments, candidates open for a proposal)`."""
    if answers is None:
        return None, candidates
    marked = cut(candidates.join(answers, [c for c in (PROJECT, "old_id") if c in answers.columns], "left"))
    accepted = assign(marked.where(F.col("rename")).drop("rename"), scope)
    claims = accepted.select(*scope, "new_id", F.col("old_order").alias("claimed_at"))
    undecided = marked.where(F.col("rename").isNull()).join(claims, [*scope, "new_id"], "left")
    open_ = undecided.where(F.col("claimed_at").isNull() | (F.col("claimed_at") > F.col("old_order")))
    return accepted, open_.drop("rename", "claimed_at")


def _proposals(best: DataFrame, kind: str, scope: list[str], table: Column) -> DataFrame:
    rivals = best.groupBy(*scope, "new_id").agg(F.count(F.lit(1)).alias("rivals"))
    flagged = best.join(rivals, [*scope, "new_id"])
    sure = confidence(F.col("score"))
    return flagged.select(
        PROJECT,
        F.lit(kind).alias("kind"),
        table.alias("table"),
        "old_id",
        "old_name",
        "new_id",
        "new_name",
        sure.alias("confidence"),
        (sure >= PRESELECT).alias("preselected"),
        (F.col("rivals") > 1).alias("contested"),
    )


@dataclass(frozen=True)
class Matching:
    proposals: DataFrame
    tables: DataFrame  # project_id, old_id, new_id
    columns: DataFrame  # project_id, old_table, new_table, old_id, new_id


def rename_proposals(head: Catalog, new: Catalog, decisions: DataFrame | None = None) -> Matching:
    """Match by name, then propose renames; accepted decisions move identity.

    `decisions(old_id, rename)` may carry `kind` (table or column) and
    `project_id` where ids are not unique across them."""
    tables = cut(match_tables(head.tables, new.tables))
    accepted, offered, _ = serve(table_candidates(head, new, tables), _answers(decisions, "table"))
    proposals = _proposals(offered, "table", [PROJECT], F.lit(None).cast("string"))
    if decisions is not None:
        tables = cut(tables.unionByName(accepted.select(PROJECT, "old_id", "new_id")))
    columns = cut(match_columns(head.columns, new.columns, tables))
    scope = [PROJECT, "old_table", "new_table"]
    found = column_candidates(head, new, tables, columns)
    accepted, open_ = _decided(found, _answers(decisions, "column"), scope)
    named = new.tables.select(PROJECT, F.col(TABLE).alias("new_table"), F.col("name").alias("_table"))
    placed = _best(open_, [*scope, "old_id"]).join(named, [PROJECT, "new_table"])
    proposals = proposals.unionByName(_proposals(placed, "column", scope, F.col("_table")))
    if accepted is not None:
        columns = columns.unionByName(accepted.select(*scope, "old_id", "new_id"))
    return Matching(proposals.select(*PROPOSAL), tables, columns)


def _remapped(df: DataFrame, key: list[str], ids: str, remap: DataFrame) -> DataFrame:
    """`(key…, ids)` with every id of the array replaced where it was moved."""
    items = df.select(*key, F.posexplode(ids).alias("_pos", "_id"))
    moved = items.join(remap.select(PROJECT, F.col("new_id").alias("_id"), "old_id"), [PROJECT, "_id"], "left")
    entry = F.struct("_pos", F.coalesce("old_id", "_id").alias("v"))
    back = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"])
    return moved.groupBy(*key).agg(back.alias(f"_{ids}"))


def transplant(head: Catalog, new: Catalog, matching: Matching) -> Catalog:
    """`new` with the ids of `head` wherever objects were matched, including all
    references; alike constraints and equally named indexes keep their ids."""
    tables = matching.tables.select(PROJECT, "new_id", "old_id")
    columns = matching.columns.select(PROJECT, "new_id", "old_id").distinct()

    def moved(df: DataFrame, col: str, remap: DataFrame) -> DataFrame:
        known = remap.select(PROJECT, F.col("new_id").alias(col), F.col("old_id").alias("_old"))
        out = df.join(known, [PROJECT, col], "left").withColumn(col, F.coalesce("_old", col)).drop("_old")
        return out.select(*df.columns)

    out_tables = moved(new.tables, TABLE, tables)
    out_columns = moved(moved(new.columns, TABLE, tables), "column_id", columns)

    key = [*SCOPE, "constraint_id"]
    cons = moved(moved(new.constraints, TABLE, tables), "ref_table_id", tables)
    for ids in ("column_ids", "ref_column_ids"):
        part = _remapped(cons, key, ids, columns)
        cons = cons.join(part, key, "left").withColumn(ids, F.coalesce(f"_{ids}", ids)).drop(f"_{ids}")
    cons = cons.select(*new.constraints.columns)
    cons = _reuse(cons, head.constraints, "constraint_id", _shape())

    key = [*SCOPE, "index_id"]
    idx = moved(new.indexes, TABLE, tables)
    items = idx.select(*key, F.posexplode("columns").alias("_pos", "_c"))
    known = columns.select(PROJECT, F.col("new_id").alias("_id"), "old_id")
    flat = items.withColumn("_id", F.col("_c.column_id")).join(known, [PROJECT, "_id"], "left")
    entry = F.struct("_pos", F.struct(F.coalesce("old_id", "_id").alias("column_id"), F.col("_c.desc").alias("desc")).alias("v"))
    back = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"])
    part = flat.groupBy(*key).agg(back.alias("_columns"))
    idx = idx.join(part, key, "left").withColumn("columns", F.coalesce("_columns", "columns")).select(*new.indexes.columns)
    idx = _reuse(idx, head.indexes, "index_id", F.col("name"))
    return Catalog(out_tables, out_columns, cons, idx)


def _shape() -> Column:
    """What makes two constraints the same: kind, columns, target, expression."""
    ids = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda i: i.cast("string")), "|")
    return F.concat_ws(
        "~",
        "kind",
        ids("column_ids"),
        F.coalesce(F.col("ref_table_id").cast("string"), F.lit("")),
        ids("ref_column_ids"),
        F.coalesce("expr", F.lit("")),
    )


def _reuse(new: DataFrame, head: DataFrame, ident: str, shape: Column) -> DataFrame:
    """Give members the head id of the same shape; the k-th takes the k-th."""
    place = lambda df: number_within(
        df.withColumn("_shape", shape), [*SCOPE, "_shape"], "ordinal", "_nth", tie=[ident]
    )
    known = place(head).select(*SCOPE, "_shape", "_nth", F.col(ident).alias("_head"))
    # as many rows as members, however few bytes their files hold
    out = place(new).join(known.hint("merge"), [*SCOPE, "_shape", "_nth"], "left")
    return out.withColumn(ident, F.coalesce("_head", ident)).select(*new.columns)
