"""Serve head objects one after another where many objects are alike.

A head object takes the best new object that nobody before it has taken. Alike
head objects (one class) want the same things in the same order, and alike new
objects are wanted alike, so nothing here is kept per pair of objects: a class
knows other classes, and an object its class.

New objects of a class form units: stretches in the new side's order that no
tied class interleaves for any head class. Every head class then has one strict
list of units. Rounds settle all objects together: each accepted head object
asks for the first unit of its list that may still have room for it, and a unit
of n objects holds the first n that ask, in head order; who is behind its last
holder asks further down in the next round. At the end the k-th holder of a unit
has its k-th object. This is what serving them one after another gives, in as
many rounds as a class is turned away, whatever the number of alike objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.catalog import PROJECT
from palimpsest.operators.spread import lookup_large, number_within, running_last
from palimpsest.session import cut

OLD = [PROJECT, "old_id", "old_name", "old_order"]
NEW = ["new_id", "new_name", "new_order"]


@dataclass(frozen=True)
class Classes:
    """Objects of both sides with their class, and the classes that are similar enough."""

    old: DataFrame  # project_id, old_id, old_name, old_order, a
    new: DataFrame  # project_id, new_id, new_name, new_order, b
    edges: DataFrame  # project_id, a, b, score


def pairs(classes: Classes) -> DataFrame:
    """Every pair of objects whose classes are similar, for whoever wants to see them all."""
    return classes.edges.join(classes.old, [PROJECT, "a"]).join(classes.new, [PROJECT, "b"]).drop("a", "b")


def units(new: DataFrame, edges: DataFrame) -> DataFrame:
    """`new` with `unit` and `place`, the number of an object inside its unit.

    Where classes tie for a head class, objects are wanted in the new side's
    order across them: a unit ends where an object of a tied class comes next.
    """
    tied = edges.groupBy(PROJECT, "a", "score").agg(F.sort_array(F.collect_set("b")).alias("tied")).where(F.size("tied") > 1)
    ties = tied.select(PROJECT, F.sha2(F.concat_ws(",", "tied"), 256).alias("tie"), F.explode("tied").alias("b")).distinct()
    merged = new.select(PROJECT, "b", "new_id", "new_order").join(ties, [PROJECT, "b"])
    seen = running_last(merged, [PROJECT, "tie"], "new_order", {"last": F.col("b")}, inclusive=False, tie=["new_id"])
    starts = seen.where(F.col("last") != F.col("b")).select(PROJECT, "new_id", F.lit(True).alias("starts")).distinct()
    marked = new.join(starts, [PROJECT, "new_id"], "left")
    start = {"start": F.when(F.col("starts"), F.col("new_id"))}
    placed = running_last(marked, [PROJECT, "b"], "new_order", start, inclusive=True, tie=["new_id"])
    named = placed.withColumn("unit", F.concat_ws("/", "b", F.col("start").cast("string"))).drop("starts", "start")
    return number_within(named, [PROJECT, "unit"], "new_order", "place", tie=["new_id"])


def _menus(lists: DataFrame, cutoffs: DataFrame | None, turn: str) -> DataFrame:
    """For each head class the units of its list that can be the first with room for some object.

    A unit with a cutoff is full; it has room for objects up to its last holder
    only. After a unit that is not full nothing is needed, nor is a unit whose
    cutoff lies before one that comes earlier.
    """
    if cutoffs is None:
        lists = lists.withColumn("cutoff", F.lit(None).cast(turn))
        useful = F.row_number().over(Window.partitionBy(PROJECT, "a").orderBy(F.desc("score"), "first")) == 1
        best = lists.withColumn("useful", useful)
    else:
        above = Window.partitionBy(PROJECT, "a").orderBy(F.desc("score"), "first").rowsBetween(Window.unboundedPreceding, -1)
        met = lists.join(cutoffs, [PROJECT, "unit"], "left")
        room = F.coalesce(F.max(F.col("cutoff").isNull()).over(above), F.lit(False))
        highest = F.max("cutoff").over(above)
        best = met.withColumn("useful", ~room & (F.col("cutoff").isNull() | highest.isNull() | (F.col("cutoff") > highest)))
    entry = F.struct((-F.col("score")).alias("worse"), "first", "unit", "cap", "cutoff")
    return best.where("useful").groupBy(PROJECT, "a").agg(F.array_sort(F.collect_list(entry)).alias("menu"))


def _asking(heads: DataFrame, menus: DataFrame) -> DataFrame:
    """`heads` with the unit each asks for, its size and score."""
    met = lookup_large(heads, menus, [PROJECT, "a"], ["old_id"])
    first = F.get(F.filter("menu", lambda m: m["cutoff"].isNull() | (m["cutoff"] >= F.struct("old_order", "old_id"))), F.lit(0))
    picked = met.withColumn("pick", first).where(F.col("pick").isNotNull())
    return picked.select(*heads.columns, "pick.unit", "pick.cap", (-F.col("pick.worse")).alias("score"))


def serve(classes: Classes, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """`(taken, offered, rounds)`: the new object of each head object that is
    accepted, the one that each undecided head object would get at its turn, and
    how many rounds it took.

    `answers` holds at most one row `(project_id?, old_id, rename)` per head
    object; true takes, false stands aside, an object without a row is undecided
    and takes nothing. Both results are
    `(project_id, old_id, old_name, old_order, new_id, new_name, new_order, score)`.
    """
    items = cut(units(classes.new, classes.edges))
    sizes = items.groupBy(PROJECT, "unit", "b").agg(F.count(F.lit(1)).alias("cap"), F.min(F.struct("new_order", "new_id")).alias("first"))
    lists = cut(classes.edges.join(sizes, [PROJECT, "b"]).select(PROJECT, "a", "score", "unit", "cap", "first"))
    turn = classes.old.select(F.struct("old_order", "old_id").alias("turn")).schema["turn"].dataType.simpleString()
    heads, cutoffs, rounds = classes.old, None, 0
    held = heads.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("unit", "string"), ("cap", "long"), ("score", "double"), ("place", "int"))])
    if answers is not None:
        marked = cut(heads.join(answers, [c for c in (PROJECT, "old_id") if c in answers.columns], "left"))
        heads, takers = marked.where(F.col("rename").isNull()).drop("rename"), marked.where(F.col("rename")).drop("rename")
        while True:
            asks = _asking(takers, _menus(lists, cutoffs, turn))
            held, rounds = cut(number_within(asks, [PROJECT, "unit"], "old_order", "place", tie=["old_id"])), rounds + 1
            full = held.where(F.col("place") == F.col("cap"))
            cutoffs = cut(full.select(PROJECT, "unit", F.struct("old_order", "old_id").alias("cutoff")))
            if held.where(F.col("place") > F.col("cap")).isEmpty():
                break
    wanted = _asking(heads, _menus(lists, cutoffs, turn))
    if answers is None:
        wanted = wanted.withColumn("place", F.lit(1))
    else:
        # an undecided object is offered what comes after the holders before it
        wanted = cut(wanted)
        turns = [df.select(PROJECT, "unit", "old_order", "old_id", F.lit(h).alias("holds")) for df, h in ((wanted, False), (held, True))]
        numbered = number_within(turns[0].unionByName(turns[1]), [PROJECT, "unit"], "old_order", "among_all", tie=["old_id"])
        own = number_within(numbered.where(~F.col("holds")), [PROJECT, "unit"], "old_order", "among_open", tie=["old_id"])
        place = (F.col("among_all") - F.col("among_open") + 1).alias("place")
        wanted = wanted.join(own.select(PROJECT, "old_id", place), [PROJECT, "old_id"])
    objects = items.select(PROJECT, "unit", "place", *NEW)
    taken, offered = (df.join(objects, [PROJECT, "unit", "place"]).select(*OLD, *NEW, "score") for df in (held, wanted))
    return taken, offered, rounds
