"""Load a schema again: match, check, compare, and say what comes of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.catalog import PROJECT, Catalog
from palimpsest.operators.catalog_checks import check_catalog
from palimpsest.operators.catalog_diff import catalog_diff
from palimpsest.operators.match import rename_proposals, transplant
from palimpsest.session import cut


@dataclass(frozen=True)
class Reimport:
    status: DataFrame  # project_id, n_proposals, n_problems, n_changes, status
    proposals: DataFrame
    problems: DataFrame
    changes: DataFrame
    catalog: Catalog  # the new schema under the ids of the head


def reimport(head: Catalog, new: Catalog, decisions: DataFrame | None = None, *, confirm: bool = False) -> Reimport:
    """Per project: needs_decision while proposals are open (unless `confirm`
    takes them as drop and add), invalid, no_change, or commit."""
    matching = rename_proposals(head, new, decisions)
    moved = transplant(head, new, matching).map(cut)
    proposals, problems, changes = cut(matching.proposals), cut(check_catalog(moved)), cut(catalog_diff(head, moved))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(PROJECT).agg(F.count(F.lit(1)).alias(name))

    out = new.tables.select(PROJECT).distinct()
    for df, name in ((proposals, "n_proposals"), (problems, "n_problems"), (changes, "n_changes")):
        out = out.join(counted(df, name), PROJECT, "left")
    out = out.na.fill(0)
    status = (
        F.when((F.col("n_proposals") > 0) & F.lit(not confirm), "needs_decision")
        .when(F.col("n_problems") > 0, "invalid")
        .when(F.col("n_changes") == 0, "no_change")
        .otherwise("commit")
    )
    return Reimport(out.withColumn("status", status), proposals, problems, changes, moved)
