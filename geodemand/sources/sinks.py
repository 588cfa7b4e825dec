"""Sinks that hold tables to the provenance contract, and the per-node JSON sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.functions.scalars import finite_or_null

# Provenance words, weakest evidence first.
PROVENANCE = ("simulated", "allocated", "real")


def unknown_provenance(df: DataFrame, column: str = "provenance") -> DataFrame:
    """Distinct values outside the vocabulary; nulls are not counted."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*PROVENANCE)).select(column).distinct()


def write_table(df: DataFrame, path: str, provenance_required: bool = True, mode: str = "error") -> str:
    """Write parquet once the provenance contract holds."""
    if provenance_required and "provenance" not in df.columns:
        raise ValueError(f"{path}: a provenance column (one of {PROVENANCE}) is required")
    if "provenance" in df.columns:
        bad = [r[0] for r in unknown_provenance(df).limit(5).collect()]
        if bad:
            raise ValueError(f"{path}: unknown provenance values {bad}")
    df.write.mode(mode).parquet(path)
    return path


def provenance_strength(c: str | Column) -> Column:
    """Position in the vocabulary, null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    pos = F.array_position(F.array(*[F.lit(p) for p in PROVENANCE]), c)
    return F.when(pos > 0, pos)


def _word(strength: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*[F.lit(p) for p in PROVENANCE]), strength.cast("int")), F.lit(PROVENANCE[0]))


def weakest_of_columns(columns: list[str]) -> Column:
    """Weakest evidence among the columns of a row."""
    return _word(F.least(*[provenance_strength(c) for c in columns]))


def weakest_of_rows(column: str) -> Column:
    """Aggregate form: weakest evidence in a group."""
    return _word(F.min(provenance_strength(column)))


def null_clean(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, also inside arrays and structs."""

    def fix(c: Column, t) -> Column:
        kind = t.typeName()
        if kind in ("double", "float"):
            return finite_or_null(c)
        if kind == "array":
            return F.transform(c, lambda x: fix(x, t.elementType))
        if kind == "struct":
            made = F.struct(*[fix(c[f.name], f.dataType).alias(f.name) for f in t])
            return F.when(c.isNotNull(), made)
        return c

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def write_nodes_json(df: DataFrame, path: str, node: list[str], mode: str = "error") -> None:
    """One JSON folder per node of the hierarchy."""
    null_clean(df).write.mode(mode).partitionBy(*node).json(path)
