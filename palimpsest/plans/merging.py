"""Merge branches into branches, many at once.

One request is `(merge_id, into_ref, from_ref)`: the branch `from_ref` is merged
into the branch `into_ref`. All requests go through one merge: the base of every
pair of heads is found in the commit graph, the three snapshots of each request
are put side by side under its `merge_id`, and what comes out is judged for each
request by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import catalog_diff, catalog_merge, history
from palimpsest.operators.catalog import PROJECT, Catalog
from palimpsest.operators.catalog_checks import check_catalog
from palimpsest.session import cut

#: Why a request is not merged, in the order in which it is looked at.
REFUSED = ["unknown_branch", "cross_project", "same_branch", "no_common_ancestor", "invalid_resolution", "conflicts", "problems"]


@dataclass(frozen=True)
class RefMerges:
    """Everything but `status` is keyed by `project_id`, which holds the `merge_id`."""

    status: DataFrame  # merge_id, status, base, ours, theirs, message, n_conflicts, n_problems, n_new_problems, n_changes
    merged: Catalog  # of requests with status `merged`
    conflicts: DataFrame  # open conflicts
    problems: DataFrame  # of every merged schema; `new`: neither side has it by itself
    changes: DataFrame  # what the merge brings to the branch merged into


def resolve_requests(branches: DataFrame, requests: DataFrame) -> DataFrame:
    """`(merge_id, into_name, from_name, ours, theirs, refused)`: branches by id, and
    why a request cannot be merged at all."""
    out = requests
    for end in ("into", "from"):
        named = branches.select(
            F.col("branch_id").cast("string").alias(f"{end}_ref"),
            F.col("name").alias(f"{end}_name"),
            F.col("project_id").alias(f"{end}_project"),
            F.col("head_commit_id").alias("ours" if end == "into" else "theirs"),
        )
        out = out.join(named, f"{end}_ref", "left")
    refused = (
        F.when(F.col("ours").isNull() | F.col("theirs").isNull(), "unknown_branch")
        .when(F.col("into_project") != F.col("from_project"), "cross_project")
        .when(F.col("into_ref") == F.col("from_ref"), "same_branch")
    )
    return out.withColumn("refused", refused).select("merge_id", "into_name", "from_name", "ours", "theirs", "refused")


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col(PROJECT).alias("merge_id")).agg(F.count(F.lit(1)).alias(name))


def merge_refs(
    snapshots: Catalog,
    graph: history.Graph,
    branches: DataFrame,
    requests: DataFrame,
    resolutions: DataFrame | None = None,
) -> RefMerges:
    """Merge all `requests`; `snapshots` is a catalog with `commit_id`.

    Conflict ids hold the `merge_id` where those of a catalog merge hold the
    project, so `resolutions` answer each request by itself. `status` is `merged`
    or the first of REFUSED that holds.
    """
    asked = cut(resolve_requests(branches, requests))
    fit = asked.where(F.col("refused").isNull())
    found = history.merge_base(graph, fit.select(F.col("ours").alias("a"), F.col("theirs").alias("b")))
    bases = found.select(F.col("a").alias("ours"), F.col("b").alias("theirs"), "base")
    based = cut(asked.join(bases, ["ours", "theirs"], "left"))
    ends = based.where(F.col("base").isNotNull() & F.col("refused").isNull())
    at = lambda commit: catalog_diff.snapshots_at(
        snapshots, ends.select(F.col("merge_id").alias(PROJECT), F.col(commit).alias("commit_id"))
    ).map(cut)
    base, ours, theirs = at("base"), at("ours"), at("theirs")
    attempt = catalog_merge.merge_catalogs(base, ours, theirs, resolutions)
    merged, conflicts = attempt.merged.map(cut), cut(attempt.conflicts)

    own = [PROJECT, "code", "table", "object"]
    met = check_catalog(merged)
    alone = check_catalog(ours).unionByName(check_catalog(theirs)).select(*own).distinct()
    known = alone.select(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"k{i}") for i, c in enumerate(own)], F.lit(False).alias("new"))
    keyed = met.withColumns({f"k{i}": F.coalesce(F.col(c).cast("string"), F.lit("\0")) for i, c in enumerate(own)})
    problems = keyed.join(known, [f"k{i}" for i in range(len(own))], "left").select(*met.columns, F.coalesce("new", F.lit(True)).alias("new"))
    left_out = attempt.skipped.select(PROJECT, F.col("problem").alias("code"))
    problems = cut(problems)
    wrong = attempt.resolution_problems.where("severity = 'error'")
    wrong = wrong.select(F.regexp_extract("conflict_id", "^[a-z_]+:([^:]*)", 1).alias("id")).distinct()

    changes = catalog_diff.catalog_diff(ours, merged)
    counts = based
    for df, name in (
        (conflicts, "n_conflicts"),
        (problems.select(PROJECT).unionByName(left_out.select(PROJECT)), "n_problems"),
        (problems.where("new"), "n_new_problems"),
        (changes, "n_changes"),
    ):
        counts = counts.join(_counted(df, name), "merge_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    invalid = wrong.select(F.col("id").alias("_id"), F.lit(True).alias("_invalid"))
    counts = counts.join(invalid, F.col("merge_id").cast("string") == F.col("_id"), "left")
    status = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("base").isNull(), "no_common_ancestor")
        .when(F.col("_invalid"), "invalid_resolution")
        .when(F.col("n_conflicts") > 0, "conflicts")
        .when(F.col("n_problems") > 0, "problems")
        .otherwise("merged")
    )
    message = F.concat(F.lit("Merge "), "from_name", F.lit(" into "), "into_name")
    told = ["n_conflicts", "n_problems", "n_new_problems", "n_changes"]
    judged = cut(counts.select("merge_id", status.alias("status"), "base", "ours", "theirs", message.alias("message"), *told))
    whole = judged.where("status = 'merged'").select(F.col("merge_id").alias(PROJECT))
    only = lambda df: df.join(whole, PROJECT, "left_semi")
    return RefMerges(judged, merged.map(only), conflicts, problems, only(changes))
