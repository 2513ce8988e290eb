"""Result columns beside any input columns: clashes in names are settled in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns that results will replace (names count alike in any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def set_aside(df: DataFrame, names: Iterable[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` applied with columns of those names out of its way; they come back under their own names and in place."""
    taken = {n.lower() for n in names}
    away = {c: f"__aside_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    done = step(df.withColumnsRenamed(away) if away else df)
    return done.select(*[done[f"`{away.get(c, c)}`"].alias(c) for c in df.columns])
