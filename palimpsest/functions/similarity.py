"""How alike two names or two columns are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and weights of the identity score.
TABLE_THRESHOLD = 0.4
COLUMN_THRESHOLD = 0.5
PRESELECT = 0.7
SAME_TYPE, SAME_BASE = 0.5, 0.3
SAME_POSITION, NEXT_POSITION = 0.2, 0.1
NAME_WEIGHT = 0.3


def name_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length. Spark counts characters."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    close = F.lit(1.0) - F.levenshtein(a, b) / longer
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(close)


def column_similarity(
    name_a: Column, name_b: Column, base_a: Column, base_b: Column, type_a: Column, type_b: Column, pos_a: Column, pos_b: Column
) -> Column:
    by_type = F.when(type_a == type_b, SAME_TYPE).when(base_a == base_b, SAME_BASE).otherwise(0.0)
    by_place = F.when(pos_a == pos_b, SAME_POSITION).when(F.abs(pos_a - pos_b) == 1, NEXT_POSITION).otherwise(0.0)
    return F.least(by_type + by_place + NAME_WEIGHT * name_similarity(name_a, name_b), F.lit(1.0))


def confidence(score: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(score * 100 + 0.5) / 100
