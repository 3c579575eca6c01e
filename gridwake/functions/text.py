"""String column expressions: names, paths and ordered token rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwake.functions.numeric import as_col


def topic_of(channel) -> Column:
    return F.split(as_col(channel), r"\.", 2)[0]


def field_of(channel) -> Column:
    """Everything after the first dot, or the whole name when there is none."""
    parts = F.split(as_col(channel), r"\.", 2)
    return F.coalesce(F.get(parts, F.lit(1)), as_col(channel))


def run_part(run_id, index: int) -> Column:
    """Zero-based `__` separated part of a run identifier."""
    return F.get(F.split(as_col(run_id), "__"), F.lit(index))


def pair_key(run_id) -> Column:
    """A run identifier without its last part, shared by the two runs of a pair."""
    return F.regexp_replace(as_col(run_id), "__(?:(?!__).)*$", "")


def first_token(value, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """Label of the first rule any of whose tokens occurs in the lower-cased value."""
    v = F.lower(as_col(value))
    expr = None
    for label, tokens in rules:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | v.contains(token)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr.otherwise(F.lit(default).cast("string"))


def module_of(path, roots: Sequence[str] = ("modules", "drivers", "examples", "systemcmds", "lib")) -> Column:
    """First three segments below a known source root, else the parent directory, else `.`."""
    parts = F.split(as_col(path), "/")
    known = (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "src") & F.get(parts, F.lit(1)).isin(*roots)
    parent = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return F.when(known, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(
        F.when(parent == "", F.lit(".")).otherwise(parent)
    )
