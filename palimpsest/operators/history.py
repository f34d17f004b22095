"""Bulk questions about commit graphs.

`commits(project_id, commit_id, parent_id, parent2_id, …)`; commit ids are
unique. A walk that takes one join per generation needs as many rounds as the
history is deep. Here first-parent lines are first cut into chains and each
commit gets its position on its chain, in log2(depth) rounds. Everything a
commit can reach on a chain is then one number, the highest position, and the
walks take one round per *branch change* instead of one per commit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lists import rank_lists
from palimpsest.operators.spread import lookup_large
from palimpsest.session import cut


@dataclass(frozen=True)
class Graph:
    """A commit graph cut into chains."""

    commits: DataFrame  # all commit columns, chain, pos
    edges: DataFrame  # chain, from_pos, bit, to_chain, to_pos: every parent link that leaves a chain


def graph(commits: DataFrame) -> Graph:
    """Cut first-parent lines into chains; the least child continues a line."""
    children = commits.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.min("commit_id").alias("commit_id"))
    heirs = children.join(commits.select(F.col("commit_id").alias("parent_id")), "parent_id", "left_semi")
    linked = commits.select("commit_id").join(heirs, "commit_id", "left")
    ranked = rank_lists(linked.select(F.col("commit_id").alias("id"), F.col("parent_id").alias("pred")))
    placed = ranked.select(F.col("id").alias("commit_id"), F.col("head").alias("chain"), F.col("dist").alias("pos"))
    full = cut(commits.join(placed, "commit_id"))
    here = full.select(F.col("commit_id").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    links = full.select(
        "chain",
        F.col("pos").alias("from_pos"),
        F.posexplode(F.array("parent_id", "parent2_id")).alias("bit", "parent"),
    ).where(F.col("parent").isNotNull())
    met = lookup_large(links, here, ["parent"], ["chain", "from_pos"])
    along = (F.col("bit") == 0) & (F.col("chain") == F.col("to_chain")) & (F.col("to_pos") == F.col("from_pos") - 1)
    edges = met.where(~along).select("chain", "from_pos", "bit", "to_chain", "to_pos")
    return Graph(full, cut(edges))


def reach(g: Graph, starts: DataFrame) -> DataFrame:
    """`(start, chain, hi)`: on each chain everything up to `hi` is an
    ancestor-or-self of `start`. `starts` has a column `start` of commit ids."""
    at = g.commits.select(F.col("commit_id").alias("start"), "chain", F.col("pos").alias("hi"))
    known = cut(starts.select("start").distinct().join(at, "start"))
    fresh = known.withColumn("lo", F.lit(-1).cast("long"))
    while True:
        step = g.edges.join(fresh, "chain").where((F.col("from_pos") > F.col("lo")) & (F.col("from_pos") <= F.col("hi")))
        offered = step.groupBy("start", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("hi"))
        had = known.select("start", "chain", F.col("hi").alias("lo"))
        better = offered.join(had, ["start", "chain"], "left").where(F.col("lo").isNull() | (F.col("hi") > F.col("lo")))
        fresh = cut(better.select("start", "chain", "hi", F.coalesce("lo", F.lit(-1)).alias("lo")))
        if fresh.isEmpty():
            return known
        both = known.unionByName(fresh.select("start", "chain", "hi"))
        known = cut(both.groupBy("start", "chain").agg(F.max("hi").alias("hi")))


def ancestors(g: Graph, starts: DataFrame) -> DataFrame:
    """`(start, commit_id)`: every ancestor-or-self of every start."""
    spans = reach(g, starts)
    placed = g.commits.select("commit_id", "chain", "pos")
    return lookup_large(placed, spans, ["chain"], ["commit_id"]).where(F.col("pos") <= F.col("hi")).select("start", "commit_id")


def _spans(g: Graph, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = pairs.select(F.col("a").alias("start")).unionByName(pairs.select(F.col("b").alias("start")))
    spans = reach(g, ends)
    return (
        spans.select(F.col("start").alias("a"), "chain", F.col("hi").alias("a_hi")),
        spans.select(F.col("start").alias("b"), "chain", F.col("hi").alias("b_hi")),
    )


def merge_base(g: Graph, pairs: DataFrame) -> DataFrame:
    """`(a, b, base, status)` for pairs of commits.

    The base is the first commit in a breadth-first walk from `b`, first parent
    before second, that is `a` or an ancestor of it: least depth, then least
    sequence of parent choices. The sequence is kept as the negated steps at
    which a second parent was taken, which sorts the same way and does not grow
    along a chain. Inside a chain the first hit is arithmetic, so the walk only
    follows links between chains, and only above what `a` reaches.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    of_a, of_b = _spans(g, pairs)
    of_a = cut(of_a)
    related = cut(pairs.join(of_a, "a").join(of_b, ["b", "chain"], "left_semi").select("a", "b").distinct())
    at = g.commits.select(F.col("commit_id").alias("b"), "chain", "pos")
    path = F.array().cast("array<bigint>")
    fresh = cut(related.join(at, "b").select("a", "b", "chain", "pos", F.lit(0).cast("long").alias("depth"), path.alias("path")))
    entries = fresh
    hits = None
    while True:
        met = fresh.join(of_a, ["a", "chain"], "left")
        stop = F.least("pos", "a_hi")
        found = met.where(F.col("a_hi").isNotNull()).select(
            "a", "b", F.struct((F.col("depth") + F.col("pos") - stop).alias("depth"), "path", "chain", stop.alias("pos")).alias("hit")
        )
        all_hits = found if hits is None else hits.unionByName(found)
        hits = cut(all_hits.groupBy("a", "b").agg(F.min("hit").alias("hit")))
        open_ = met.where(F.col("a_hi").isNull() | (F.col("pos") > F.col("a_hi"))).withColumn("floor", F.coalesce("a_hi", F.lit(-1)))
        step = g.edges.join(open_.drop("a_hi"), "chain").where(
            (F.col("from_pos") <= F.col("pos")) & (F.col("from_pos") > F.col("floor"))
        )
        taken = F.col("depth") + F.col("pos") - F.col("from_pos")
        walked = F.when(F.col("bit") == 1, F.concat("path", F.array(-taken))).otherwise(F.col("path"))
        reached = (
            step.groupBy("a", "b", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"))
            .agg(F.min(F.struct((taken + 1).alias("depth"), walked.alias("path"))).alias("w"))
            .join(hits, ["a", "b"], "left")
            .where(F.col("hit").isNull() | (F.col("w.depth") <= F.col("hit.depth")))
            .select("a", "b", "chain", "pos", "w")
        )
        had = entries.select("a", "b", "chain", "pos", F.struct("depth", "path").alias("had"))
        better = reached.join(had, ["a", "b", "chain", "pos"], "left").where(F.col("had").isNull() | (F.col("w") < F.col("had")))
        fresh = cut(better.select("a", "b", "chain", "pos", "w.depth", "w.path"))
        if fresh.isEmpty():
            break
        both = entries.unionByName(fresh).groupBy("a", "b", "chain", "pos")
        entries = cut(both.agg(F.min(F.struct("depth", "path")).alias("w")).select("a", "b", "chain", "pos", "w.depth", "w.path"))
    named = hits.select("a", "b", "hit.chain", "hit.pos").join(g.commits.select("chain", "pos", F.col("commit_id").alias("base")), ["chain", "pos"])
    out = pairs.join(named.select("a", "b", "base"), ["a", "b"], "left")
    status = F.when(F.col("base").isNull(), "no_common_ancestor").otherwise("found")
    return out.select("a", "b", "base", status.alias("status"))


def divergence(g: Graph, pairs: DataFrame) -> DataFrame:
    """`(a, b, a_only, b_only)`: commits reachable from one end only, by
    interval arithmetic on the chains."""
    of_a, of_b = _spans(g, pairs)
    wanted = pairs.select("a", "b").distinct()
    left = wanted.join(of_a, "a").select("a", "b", "chain", "a_hi", F.lit(-1).cast("long").alias("b_hi"))
    right = wanted.join(of_b, "b").select("a", "b", "chain", F.lit(-1).cast("long").alias("a_hi"), "b_hi")
    per_chain = left.unionByName(right).groupBy("a", "b", "chain").agg(F.max("a_hi").alias("x"), F.max("b_hi").alias("y"))
    return per_chain.groupBy("a", "b").agg(
        F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("a_only"),
        F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("b_only"),
    )


def first_parent_history(g: Graph, starts: DataFrame, limit: int) -> DataFrame:
    """`(start, depth, commit_id)`: the first-parent line from each start,
    `depth < limit`."""
    at = g.commits.select(F.col("commit_id").alias("start"), "chain", "pos")
    fresh = starts.select("start").distinct().join(at, "start").withColumn("depth", F.lit(0).cast("long"))
    fresh = cut(fresh)
    segments = fresh
    roots = g.edges.where((F.col("from_pos") == 0) & (F.col("bit") == 0))
    while True:
        step = lookup_large(fresh, roots, ["chain"], ["start"])
        depth = F.col("depth") + F.col("pos") + 1
        moved = step.select("start", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), depth.alias("depth"))
        fresh = cut(moved.where(F.col("depth") < limit))
        if fresh.isEmpty():
            break
        segments = segments.unionByName(fresh)
    # A segment is at most `limit` places, so it meets its commits place by place
    # and not every commit of a long chain.
    last = F.greatest(F.lit(0).cast("long"), F.col("pos") - (F.lit(limit - 1) - F.col("depth")))
    places = segments.where(F.col("depth") < limit).withColumn("at", F.explode(F.sequence("pos", last, F.lit(-1).cast("long"))))
    places = places.select("start", (F.col("depth") + F.col("pos") - F.col("at")).alias("depth"), "chain", "at")
    placed = g.commits.select("commit_id", "chain", F.col("pos").alias("at"))
    return lookup_large(places, placed, ["chain", "at"], ["start"]).select("start", "depth", "commit_id")


def commit_list(g: Graph, starts: DataFrame, tables: DataFrame, limit: int = 100) -> DataFrame:
    """First-parent history with the number of tables of each snapshot."""
    counts = tables.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n_tables"))
    line = first_parent_history(g, starts, limit)
    return lookup_large(line, counts, ["commit_id"], ["start", "depth"], "left").select(
        "start", "depth", "commit_id", F.coalesce("n_tables", F.lit(0)).alias("n_tables")
    )


def commit_graph(commits: DataFrame, branches: DataFrame, limit: int = 200) -> DataFrame:
    """The newest `limit` commits of each project with parents and head counts.

    The rank filter becomes a group limit that Spark applies before the
    exchange, so a project with most of the commits sends `limit` rows per task.
    Which branches stand on a commit is `commit_heads`, in long form.
    """
    newest = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("commit_id"))
    top = commits.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    heads = branches.groupBy(F.col("head_commit_id").alias("commit_id")).agg(F.count(F.lit(1)).alias("n_heads"))
    parents = F.array_compact(F.array("parent_id", "parent2_id"))
    return top.join(heads, "commit_id", "left").select(
        "project_id",
        "commit_id",
        "rank",
        parents.alias("parents"),
        (F.size(parents) > 1).alias("is_merge"),
        F.coalesce("n_heads", F.lit(0)).alias("n_heads"),
    )


def commit_heads(commits: DataFrame, branches: DataFrame) -> DataFrame:
    """`(project_id, commit_id, branch)`, one row per branch on its head."""
    named = branches.select(F.col("head_commit_id").alias("commit_id"), F.col("name").alias("branch"))
    return lookup_large(named, commits.select("project_id", "commit_id"), ["commit_id"], ["branch"]).select(
        "project_id", "commit_id", "branch"
    )


def head_moves(branches: DataFrame, proposals: DataFrame) -> DataFrame:
    """Compare-and-swap of branch heads over a log of proposals.

    `proposals(branch_id, seq, commit_id, expected_head)` arrive in the order of
    `seq`; one is accepted when its expected head is the head at that moment.
    Returns the proposals with `status` accepted or stale, or repeated_commit for
    a commit id already seen on the branch. Commit ids are new otherwise, so a head is current in one stretch only: the first proposal
    that expects it after its arrival is the one that replaces it. The accepted
    proposals are the list that starts at the branch's head, found by pointer
    doubling and not by reading a branch in order.
    """
    ids = ["branch_id", "commit_id"]
    start = branches.select("branch_id", F.col("head_commit_id").alias("commit_id"))
    # A commit already on the branch cannot be committed again: the first stays.
    first = proposals.groupBy(*ids).agg(F.min("seq").alias("seq"))
    # read five times below
    new = cut(first.join(start, ids, "left_anti").join(proposals, [*ids, "seq"], "left_semi"))
    holders = new.select("branch_id", F.col("commit_id").alias("expected_head"), F.col("seq").alias("since")).unionByName(
        start.select("branch_id", F.col("commit_id").alias("expected_head"), F.lit(None).cast("long").alias("since"))
    )
    fresh = proposals.join(new.select(*ids, "seq"), [*ids, "seq"], "left_semi")
    waiting = lookup_large(fresh, holders, ["branch_id", "expected_head"], ["commit_id"])
    later = waiting.where(F.col("since").isNull() | (F.col("seq") > F.col("since")))
    heirs = later.groupBy("branch_id", "expected_head").agg(F.min_by("commit_id", "seq").alias("commit_id"))
    node = lambda c: F.struct("branch_id", F.col(c).alias("commit_id"))
    listed = start.select(node("commit_id").alias("id"), F.lit(None).cast(heirs.select(node("commit_id").alias("x")).schema["x"].dataType).alias("pred")).unionByName(
        heirs.select(node("commit_id").alias("id"), node("expected_head").alias("pred"))
    )
    # A list whose first node is no proposal and no head never becomes current.
    rooted = listed.select("id").distinct()
    orphan_heads = listed.where(F.col("pred").isNotNull()).select(F.col("pred").alias("id")).join(rooted, "id", "left_anti")
    whole = listed.unionByName(orphan_heads.distinct().select("id", F.lit(None).cast(listed.schema["pred"].dataType).alias("pred")))
    ranked = rank_lists(whole)
    heads = start.select(node("commit_id").alias("head"))
    winners = lookup_large(ranked, heads, ["head"], ["id"], "left_semi").where(F.col("dist") > 0).select("id.branch_id", "id.commit_id")
    chosen = new.join(winners, ids, "left_semi").select("branch_id", "seq", F.lit(True).alias("_won"))
    once = new.select("branch_id", "seq", F.lit(True).alias("_new"))
    status = F.when(F.col("_won"), "accepted").when(F.col("_new"), "stale").otherwise("repeated_commit")
    judged = proposals.join(once, ["branch_id", "seq"], "left").join(chosen, ["branch_id", "seq"], "left")
    return judged.withColumn("status", status).drop("_won", "_new")


def audit_windows(
    events: DataFrame, width: str, by: Sequence[str], detail: str | None = None, detail_schema: str | None = None
) -> DataFrame:
    """Events per tumbling window and group; with `detail` also the parsed JSON
    field sums of `detail_schema`."""
    base = events
    aggs = [F.count(F.lit(1)).alias("n_events")]
    if detail is not None:
        base = base.withColumn("_d", F.from_json(detail, detail_schema))
        for f in base.schema["_d"].dataType.fields:
            aggs.append(F.sum(F.col("_d")[f.name]).alias(f"sum_{f.name}"))
    grouped = base.groupBy(F.window("ts", width).alias("w"), *by).agg(*aggs)
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])
