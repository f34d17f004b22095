"""Replay of schema edits on a fleet, all streams at once and without a row loop.

An edit is one row of
log(project_id, seq, op, table_id, column_id, constraint_id, index_id, name, type, nullable, default_expr,
    columns array<struct<column_id,name,type,nullable,default_expr>>, kind, column_ids, ref_table_id,
    ref_column_ids, on_delete, on_update, expr, index_columns array<struct<column_id,desc>>, is_unique, method)
with `seq` (not negative) unique in its stream, which is `project_id`. New objects bring their ids.

A stream is atomic: its first failing edit is reported and its base stays. Every
rule asks about the state just before an edit, which depends on earlier edits
only, so all edits are judged side by side as if none had failed: up to the
first failure of a stream that is the true state, and what comes after it does
not count. Objects get lifetimes `(born, died)`; names, index names and the one
primary key of a table are slots that are taken and freed, and the holder before
an edit is the last entry of its slot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.words import has_text
from palimpsest.operators.catalog import PROJECT, SCOPE, TABLE, Catalog, plain_columns, typed_columns
from palimpsest.operators.spread import ROWS, number_within, running_last
from palimpsest.session import cut

BASE = -1
OPS = [
    "create_table",
    "drop_table",
    "rename_table",
    "add_column",
    "drop_column",
    "rename_column",
    "retype_column",
    "set_nullable",
    "set_default",
    "add_constraint",
    "drop_constraint",
    "add_index",
    "drop_index",
]
ON_COLUMN = ["drop_column", "rename_column", "retype_column", "set_nullable", "set_default"]
CONSTRAINT_FIELDS = ["name", "kind", "column_ids", "ref_table_id", "ref_column_ids", "on_delete", "on_update", "expr"]
INDEX_FIELDS = ["name", "columns", "is_unique", "method"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _at(seq: int) -> Column:
    return F.lit(seq).cast("long")


def _alive(seq: Column | str = "seq") -> Column:
    """Alive just before the edit: born earlier, not yet gone."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.col("born").isNotNull() & (F.col("born") < s) & (F.col("died").isNull() | (F.col("died") >= s))


class _Replay:
    def __init__(self, base: Catalog, log: DataFrame, rows: int):
        self.base, self.log, self.rows = base, cut(log), rows
        self._tables()
        self._columns()
        self._members()

    # --- lifetimes ------------------------------------------------------------

    def _of(self, *ops: str) -> DataFrame:
        return self.log.where(F.col("op").isin(*ops))

    def _tables(self) -> None:
        made = self.base.tables.select(*SCOPE, _at(BASE).alias("seq"), "name", "ordinal").unionByName(
            self._of("create_table").select(*SCOPE, "seq", "name", F.col("seq").alias("ordinal"))
        )
        gone = self._of("drop_table").groupBy(*SCOPE).agg(F.min("seq").alias("died"))
        born = made.groupBy(*SCOPE).agg(
            F.min("seq").alias("born"), F.min_by("ordinal", "seq").alias("ordinal"), F.count(F.lit(1)).alias("makers")
        )
        self.tables = cut(born.join(gone, SCOPE, "left"))
        self.table_makers = made

    def _inside(self, made: DataFrame, drop: str, ident: str) -> DataFrame:
        """Lifetimes of objects that end with their table at the latest."""
        gone = self._of(drop).groupBy(*SCOPE, ident).agg(F.min("seq").alias("own"))
        with_table = self.tables.select(*SCOPE, F.col("died").alias("table_died"))
        placed = made.join(gone, [*SCOPE, ident], "left").join(with_table, SCOPE, "left")
        return placed.withColumn("died", F.least("own", "table_died")).drop("own", "table_died")

    def _columns(self) -> None:
        old = plain_columns(self.base.columns).select(
            *SCOPE, "column_id", _at(BASE).alias("born"), F.col("position").cast("long").alias("place"), "name", "type", "nullable", "default"
        )
        added = self._of("add_column").select(
            *SCOPE,
            "column_id",
            F.col("seq").alias("born"),
            _at(0).alias("place"),
            "name",
            "type",
            "nullable",
            F.coalesce("default_expr", F.lit("")).alias("default"),
        )
        created = self._of("create_table").select(*SCOPE, "seq", F.posexplode("columns").alias("i", "c")).select(
            *SCOPE,
            F.col("c.column_id").alias("column_id"),
            F.col("seq").alias("born"),
            F.col("i").cast("long").alias("place"),
            "c.name",
            "c.type",
            "c.nullable",
            F.coalesce("c.default_expr", F.lit("")).alias("default"),
        )
        self.column_makers = cut(_union([old, added, created]))
        first = self.column_makers.groupBy(*SCOPE, "column_id").agg(
            F.min("born").alias("born"), F.min_by("place", "born").alias("place"), F.count(F.lit(1)).alias("makers")
        )
        self.columns = cut(self._inside(first, "drop_column", "column_id"))

    def _members(self) -> None:
        cons = self.base.constraints.select(*SCOPE, "constraint_id", _at(BASE).alias("born"), F.col("ordinal").cast("long").alias("place"), *CONSTRAINT_FIELDS)
        more = self._of("add_constraint").select(*SCOPE, "constraint_id", F.col("seq").alias("born"), _at(0).alias("place"), *CONSTRAINT_FIELDS)
        self.constraints = cut(self._inside(cons.unionByName(more), "drop_constraint", "constraint_id"))
        idx = self.base.indexes.select(*SCOPE, "index_id", _at(BASE).alias("born"), F.col("ordinal").cast("long").alias("place"), *INDEX_FIELDS)
        more = self._of("add_index").select(
            *SCOPE, "index_id", F.col("seq").alias("born"), _at(0).alias("place"), "name", F.col("index_columns").alias("columns"), "is_unique", "method"
        )
        self.indexes = cut(self._inside(idx.unionByName(more), "drop_index", "index_id"))

    # --- slots ----------------------------------------------------------------

    def _entries(self, named: DataFrame, space: str, scope: Column, part: list[str], ident: str) -> DataFrame:
        """Take and free a slot for every change of name: `named(part…, seq,
        name)` with a null name where the object goes."""
        held = running_last(named, part, "seq", {"before": F.struct("name")}, inclusive=False, rows=self.rows)
        moved = held.where(F.col("name").isNotNull() | F.col("before.name").isNotNull())
        slot = lambda name, obj: F.struct(name.alias("name"), obj.alias("holder"))
        obj = F.col(ident).cast("string")
        nobody = F.lit(None).cast("string")
        entries = F.array_compact(
            F.array(
                F.when(
                    F.col("before.name").isNotNull() & ~F.col("before.name").eqNullSafe(F.col("name")), slot(F.col("before.name"), nobody)
                ),
                F.when(F.col("name").isNotNull() & ~F.coalesce(F.col("before.name") == F.col("name"), F.lit(False)), slot(F.col("name"), obj)),
            )
        )
        return moved.select(PROJECT, F.lit(space).alias("space"), scope.alias("scope"), "seq", F.explode(entries).alias("e")).select(
            PROJECT, "space", "scope", "seq", "e.*"
        )

    def _taken(self) -> DataFrame:
        """`(project_id, seq, space)` of edits that take a slot another object holds."""
        nothing = F.lit(None).cast("string")
        tables = _union(
            [
                self.table_makers.select(*SCOPE, "seq", "name"),
                self._of("rename_table").select(*SCOPE, "seq", "name"),
                self.tables.where(F.col("died").isNotNull()).select(*SCOPE, F.col("died").alias("seq"), nothing.alias("name")),
            ]
        )
        key = [*SCOPE, "column_id"]
        columns = _union(
            [
                self.column_makers.select(*key, F.col("born").alias("seq"), "name"),
                self._of("rename_column").select(*key, "seq", "name"),
                self.columns.where(F.col("died").isNotNull()).select(*key, F.col("died").alias("seq"), nothing.alias("name")),
            ]
        )
        key_of = lambda df, name: _union(
            [
                df.select(*SCOPE, df.columns[2], F.col("born").alias("seq"), name.alias("name")),
                df.where(F.col("died").isNotNull()).select(*SCOPE, df.columns[2], F.col("died").alias("seq"), nothing.alias("name")),
            ]
        )
        everywhere, own = F.lit(""), F.col(TABLE).cast("string")
        pks = self.constraints.where(F.col("kind") == "primary_key")
        entries = _union(
            [
                self._entries(tables, "table", everywhere, SCOPE, TABLE),
                self._entries(columns, "column", own, key, "column_id"),
                self._entries(key_of(self.indexes, F.col("name")), "index", everywhere, [*SCOPE, "index_id"], "index_id"),
                self._entries(key_of(pks, F.lit("primary key")), "pk", own, [*SCOPE, "constraint_id"], "constraint_id"),
            ]
        )
        part = [PROJECT, "space", "scope", "name"]
        before = running_last(cut(entries), part, "seq", {"last": F.struct("holder")}, inclusive=False, rows=self.rows)
        other = F.col("last.holder").isNotNull() & (F.col("last.holder") != F.col("holder"))
        return before.where(F.col("holder").isNotNull() & other & (F.col("seq") >= 0)).select(PROJECT, "seq", "space").distinct()

    # --- rules ----------------------------------------------------------------

    def errors(self) -> DataFrame:
        """`(project_id, seq, op, reason)`: the first failing edit of each stream."""
        log = self.log
        life = lambda df, ident: df.select(*SCOPE, ident, "born", "died")
        fault = lambda df, rank, reason: df.select(PROJECT, "seq", F.lit(rank).alias("rank"), F.lit(reason).alias("reason"))
        found = [fault(log.where(F.col("op").isNull() | ~F.col("op").isin(*OPS)), 0, "unknown_operation")]

        # Existence of the table, then of the object in it.
        on_table = log.where(F.col("op").isin(*[o for o in OPS if o != "create_table"]))
        found.append(fault(on_table.where(F.col(TABLE).isNull()), 1, "missing_table_id"))
        met = on_table.where(F.col(TABLE).isNotNull()).join(self.tables, SCOPE, "left")
        found.append(fault(met.where(~_alive()), 2, "table_not_found"))
        for ops, ident, lives, rank in (
            (ON_COLUMN, "column_id", self.columns, 3),
            (["drop_constraint"], "constraint_id", self.constraints, 3),
            (["drop_index"], "index_id", self.indexes, 3),
        ):
            some = self._of(*ops)
            reason = ident.replace("_id", "_not_found")
            if ident == "column_id":
                found.append(fault(some.where(F.col(ident).isNull()), rank, "missing_column_id"))
                some = some.where(F.col(ident).isNotNull())
            met = some.join(life(lives, ident), [*SCOPE, ident], "left")
            found.append(fault(met.where(~_alive()), rank + 1, reason))

        # What the edit itself must bring.
        need = lambda ops, wrong, rank, reason: found.append(fault(self._of(*ops).where(wrong), rank, reason))
        no_name = ~F.coalesce(F.col("name") != "", F.lit(False))
        no_type = ~has_text(F.col("type"))
        need(["create_table", "rename_table", "rename_column", "add_column", "add_index"], no_name, 5, "name_empty")
        need(["add_column", "retype_column"], no_type, 6, "type_missing")
        need(["create_table"], F.coalesce(F.size("columns"), F.lit(0)) <= 0, 7, "no_columns")
        blank_col = lambda c: ~F.coalesce(c["name"] != "", F.lit(False)) | ~F.coalesce(F.trim(c["type"]) != "", F.lit(False))
        need(["create_table"], F.coalesce(F.exists("columns", blank_col), F.lit(False)), 8, "column_incomplete")
        need(["set_nullable"], F.col("nullable").isNull(), 6, "value_missing")
        need(["set_default"], F.col("default_expr").isNull(), 6, "value_missing")
        width = lambda c: F.coalesce(F.size(c), F.lit(0))
        kind = F.col("kind")
        known = kind.isin("primary_key", "unique", "foreign_key", "check")
        need(["add_constraint"], ~F.coalesce(known, F.lit(False)), 10, "unknown_kind")
        need(["add_constraint"], kind.isin("primary_key", "unique") & (width("column_ids") <= 0), 12, "no_columns")
        uneven = (width("column_ids") <= 0) | (width("column_ids") != width("ref_column_ids"))
        need(["add_constraint"], (kind == "foreign_key") & uneven, 13, "column_lists_differ")
        need(["add_constraint"], (kind == "check") & ~has_text(F.col("expr")), 12, "no_expression")
        need(["add_index"], width("index_columns") <= 0, 6, "no_columns")

        # Columns a new member names, and the target of a foreign key.
        local = self._of("add_constraint").select(PROJECT, "seq", TABLE, F.explode("column_ids").alias("column_id"))
        parts = self._of("add_index").select(PROJECT, "seq", TABLE, F.explode("index_columns.column_id").alias("column_id"))
        for members in (local, parts):
            met = members.join(life(self.columns, "column_id"), [*SCOPE, "column_id"], "left")
            found.append(fault(met.where(~_alive()), 9, "column_not_found"))
        fks = self._of("add_constraint").where(kind == "foreign_key").drop(TABLE).withColumnRenamed("ref_table_id", TABLE)
        met = fks.join(self.tables, SCOPE, "left")
        found.append(fault(met.where(~_alive()), 11, "ref_table_not_found"))
        refs = fks.select(PROJECT, "seq", TABLE, F.explode("ref_column_ids").alias("column_id"))
        met = refs.join(life(self.columns, "column_id"), [*SCOPE, "column_id"], "left")
        found.append(fault(met.where(~_alive()), 14, "ref_column_not_found"))

        # Slots held by another object.
        taken = self._taken()
        for space, rank, reason in (("table", 6, "name_taken"), ("column", 9, "name_taken"), ("index", 8, "name_taken"), ("pk", 11, "has_primary_key")):
            found.append(fault(taken.where(F.col("space") == space), rank, reason))
        again = self.tables.where((F.col("makers") > 1)).select(*SCOPE)
        found.append(fault(self._of("create_table").join(again, SCOPE, "left_semi"), 9, "id_in_use"))
        again = self.columns.where((F.col("makers") > 1)).select(*SCOPE, "column_id")
        found.append(fault(self._of("add_column").join(again, [*SCOPE, "column_id"], "left_semi"), 10, "id_in_use"))

        # A column leaves only when nothing of its table uses it. Only the first
        # drop of a column can succeed, so each column is asked once.
        users = _union(
            [
                self.constraints.select(*SCOPE, F.explode(F.concat(*[F.coalesce(c, F.array()) for c in ("column_ids", "ref_column_ids")])).alias("column_id"), "born", "died"),
                self.indexes.select(*SCOPE, F.explode("columns.column_id").alias("column_id"), "born", "died"),
            ]
        )
        drops = self._of("drop_column").groupBy(*SCOPE, "column_id").agg(F.min("seq").alias("seq"))
        found.append(fault(drops.join(users, [*SCOPE, "column_id"]).where(_alive()), 15, "still_referenced"))
        found.append(fault(self._loosened_keys(), 15, "primary_key_member"))

        every = _union(found).groupBy(PROJECT, "seq").agg(F.min_by("reason", F.struct("rank", "reason")).alias("reason"))
        first = every.groupBy(PROJECT).agg(F.min("seq").alias("seq"), F.min_by("reason", "seq").alias("reason"))
        return first.join(log.select(PROJECT, "seq", "op"), [PROJECT, "seq"]).select(PROJECT, "seq", "op", "reason")

    def _loosened_keys(self) -> DataFrame:
        """Edits that make a member of a live primary key nullable."""
        key = [*SCOPE, "column_id"]
        pk = self.constraints.where(F.col("kind") == "primary_key").select(*SCOPE, F.explode("column_ids").alias("column_id"), "born", "died")
        flag = lambda v: F.lit(v).alias("member")
        none = F.lit(None).cast("boolean")
        marks = _union(
            [
                pk.select(*key, F.col("born").alias("seq"), flag(True), flag(False).alias("asks")),
                pk.where(F.col("died").isNotNull()).select(*key, F.col("died").alias("seq"), flag(False), flag(False).alias("asks")),
                self._of("set_nullable").where(F.col("nullable")).select(*key, "seq", none.alias("member"), flag(True).alias("asks")),
            ]
        )
        seen = running_last(marks, key, "seq", {"is_member": F.col("member")}, inclusive=False, rows=self.rows)
        return seen.where(F.col("asks") & F.col("is_member"))

    # --- result ---------------------------------------------------------------

    def state(self, errors: DataFrame) -> Catalog:
        """The catalog after all edits; streams with an error keep their base."""
        bad = errors.select(PROJECT)
        good = lambda df: df.join(bad, PROJECT, "left_anti")
        stay = lambda df: df.join(bad, PROJECT, "left_semi")
        standing = lambda df: good(df.where(F.col("died").isNull()))

        names = _union([self.table_makers.select(*SCOPE, "seq", "name"), self._of("rename_table").select(*SCOPE, "seq", "name")])
        last = names.groupBy(*SCOPE).agg(F.max_by("name", "seq").alias("name"))
        # New objects follow those of the base, in the order they were made.
        new = (F.col("born") >= 0).cast("int").alias("new")
        tables = standing(self.tables).join(last, SCOPE).select("*", new)
        tables = number_within(tables, [PROJECT], "ordinal", "place", leading=["new"], tie=[TABLE]).select(
            *SCOPE, "name", F.col("place").cast(self.base.tables.schema["ordinal"].dataType).alias("ordinal")
        )

        key = [*SCOPE, "column_id"]
        value = lambda **v: [v.get(c, F.lit(None)).alias(c) for c in ("name", "type", "nullable", "default")]
        box = lambda c: F.struct(c.alias("v"))
        made = self.column_makers.select(
            *key, F.col("born").alias("seq"), *value(**{c: box(F.col(c)) for c in ("name", "type", "nullable", "default")})
        )
        edit = lambda op, col, src: self._of(op).select(*key, "seq", *value(**{col: box(F.col(src))}))
        members = self._of("add_constraint").where(F.col("kind") == "primary_key")
        tightened = members.select(*SCOPE, F.explode("column_ids").alias("column_id"), "seq", *value(nullable=box(F.lit(False))))
        events = _union(
            [
                made,
                edit("rename_column", "name", "name"),
                edit("retype_column", "type", "type"),
                edit("set_nullable", "nullable", "nullable"),
                edit("set_default", "default", "default_expr"),
                tightened,
            ]
        )
        props = ("name", "type", "nullable", "default")
        final = events.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))["v"].alias(c) for c in props])
        rank = F.when(F.col("born") < 0, F.col("place")).otherwise(F.col("born")).alias("rank")
        columns = standing(self.columns).join(final, key).select("*", new, rank)
        columns = number_within(
            columns, SCOPE, "rank", "position", leading=["new"], tie=["place", "column_id"], rows=self.rows
        )

        def members_of(df: DataFrame, ident: str, fields: list[str], like: DataFrame) -> DataFrame:
            ranked = standing(df).select("*", new, F.greatest("born", "place").alias("rank"))
            placed = number_within(ranked, SCOPE, "rank", "ordinal", leading=["new"], tie=[ident])
            filled = [F.coalesce(f, F.lit("")).alias(f) if f in ("name", "on_delete", "on_update", "expr", "method") else F.col(f) for f in fields]
            return placed.select(*SCOPE, ident, *filled, F.col("ordinal").cast(like.schema["ordinal"].dataType).alias("ordinal"))

        after = Catalog(
            tables,
            typed_columns(columns.select(*key, *props, "position")),
            members_of(self.constraints, "constraint_id", CONSTRAINT_FIELDS, self.base.constraints),
            members_of(self.indexes, "index_id", INDEX_FIELDS, self.base.indexes),
        )
        back = lambda a, b: a.unionByName(stay(b).select(*a.columns))
        return Catalog(
            back(after.tables, self.base.tables),
            back(after.columns, self.base.columns),
            back(after.constraints, self.base.constraints),
            back(after.indexes, self.base.indexes),
        )


def replay_catalog(base: Catalog, log: DataFrame, *, rows: int = ROWS) -> tuple[Catalog, DataFrame]:
    """`(state, errors(project_id, seq, op, reason))`."""
    run = _Replay(base, log, rows)
    errors = cut(run.errors())
    return run.state(errors), errors
