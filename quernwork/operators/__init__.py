"""Operators: each takes DataFrames and gives a DataFrame."""

from quernwork.operators.asof import asof_join, asof_within
from quernwork.operators.grouping import cube_sets, grouping_totals, rollup_sets
from quernwork.operators.intervals import overlap_join
from quernwork.operators.joins import having, lacking, roll_up
from quernwork.operators.multisets import (
    except_all,
    except_distinct,
    intersect_all,
    intersect_distinct,
    union_all,
    union_distinct,
)
from quernwork.operators.ranking import top_k
from quernwork.operators.skew import Pieces, broadcast_up_to, cut_hot_keys, heavy_keys, part_heavy
from quernwork.operators.windows import sessions, sliding, tumbling

__all__ = [
    "Pieces",
    "asof_join",
    "asof_within",
    "broadcast_up_to",
    "cut_hot_keys",
    "cube_sets",
    "except_all",
    "except_distinct",
    "grouping_totals",
    "having",
    "heavy_keys",
    "intersect_all",
    "intersect_distinct",
    "lacking",
    "overlap_join",
    "part_heavy",
    "roll_up",
    "rollup_sets",
    "sessions",
    "sliding",
    "top_k",
    "tumbling",
    "union_all",
    "union_distinct",
]
