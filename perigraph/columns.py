"""Column roles: resolving aliases and checking what must be there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .session import require


def resolve_column(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that a column matches, without regard to case; None if there is none."""
    by_name = {c.lower(): c for c in reversed(columns)}
    return next((by_name[a.lower()] for a in aliases if a.lower() in by_name), None)


def resolve_words(columns: list[str], wanted: list[str], forbidden: tuple[str, ...] = ()) -> str | None:
    """The first column whose name holds every wanted word and no forbidden one, punctuation folded."""
    for c in columns:
        name = re.sub(r"[^a-z0-9]+", "_", c.lower())
        if all(w in name for w in wanted) and not any(w in name for w in forbidden):
            return c
    return None


def score_columns(columns: list[str], roles: dict[str, list[str]]) -> int:
    """How many roles the columns can fill: a measure for choosing among candidate tables."""
    return sum(resolve_column(columns, aliases) is not None for aliases in roles.values())


def resolve_roles(df: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """df with one column per role, named by it."""
    found = {role: resolve_column(df.columns, aliases) for role, aliases in roles.items()}
    missing = [role for role, c in found.items() if c is None]
    require(not missing, f"no column for {missing} among {df.columns}")
    return df.select(*[df[f"`{c}`"].alias(role) for role, c in found.items()])


def require_columns(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    require(not missing, f"missing columns {missing}")
    require(not exact or df.columns == columns, f"columns are {df.columns}, not {columns}")
    return df
