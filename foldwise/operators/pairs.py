"""Rows for statistics of many (left, right) pairs of expressions from one evaluation of a table.

One ``stack`` of all pairs is compiled to a method that the JVM will not optimise (beyond 8,000 bytes), and
aggregates of more than 100 fields leave code generation: both made a pair cost about a microsecond a row.
Here a row grows in three small steps, each a short ``stack``: by group of ``width`` left expressions, by chunk of right
ones, by right one.  The aggregate keyed by (group, right) then has ``width`` pairs, which share their right side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Right expressions of a chunk.
CHUNK = 8


def _stacked(df: DataFrame, keep: Sequence[str], rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    cells = [c for i, row in enumerate(rows) for c in (F.lit(i), *row)]
    return df.select(*keep, F.stack(F.lit(len(rows)), *cells).alias(*names))


def _filled(values: Sequence[Column], width: int) -> list[list[Column]]:
    values = [*values, *[F.lit(None).cast("double")] * (-len(values) % width)]
    return [values[i:i + width] for i in range(0, len(values), width)]


def pair_rows(df: DataFrame, keep: Sequence[str], left: Sequence[Column], right: Sequence[Column],
              wanted: Iterable[tuple[int, int]], width: int) -> DataFrame:
    """(keep, _g, _r, _b, _a0 .. _a{width-1}): for each row of ``df``, a row for each right expression ``_r`` and
    group ``_g`` of left ones of which a pair (positions in ``left`` and ``right``) is wanted.

    Values are doubles: ``_b`` the right one, ``_a{i}`` left expression ``_g * width + i`` (NULL beyond the last)."""
    keep = list(keep)
    rights = [f"__fw_r{i}" for i in range(len(right))]
    lefts = [f"__fw_l{i}" for i in range(len(left))]
    src = df.select(*keep, *[c.cast("double").alias(n) for c, n in zip([*right, *left], [*rights, *lefts])])
    slots = [f"_a{i}" for i in range(width)]
    groups = _filled([F.col(c) for c in lefts], width)
    grown = _stacked(src, [*keep, *rights], groups, ["_g", *slots])
    chunks = _filled([F.col(c) for c in rights], CHUNK)
    parts = [f"__fw_c{i}" for i in range(CHUNK)]
    grown = _stacked(grown, [*keep, "_g", *slots], chunks, ["__fw_chunk", *parts])
    grown = _stacked(grown, [*keep, "_g", *slots, "__fw_chunk"], [[F.col(c)] for c in parts], ["__fw_at", "_b"])
    grown = grown.select(*keep, "_g", (F.col("__fw_chunk") * CHUNK + F.col("__fw_at")).alias("_r"), "_b", *slots)
    needed = {(i // width, j) for i, j in wanted}
    across = len(chunks) * CHUNK
    if len(needed) < len(groups) * across:
        flags = F.array(*[F.lit((i, j) in needed) for i in range(len(groups)) for j in range(across)])
        grown = grown.where(F.get(flags, F.col("_g") * across + F.col("_r")))
    return grown


def places(pairs: Sequence[tuple[int, int]], n_left: int, n_right: int, width: int) -> Column:
    """The positions in ``pairs`` of the pair at (``_g``, ``slot``, ``_r``), as an array (a pair may come twice)."""
    at: dict[tuple[int, int], list[int]] = {}
    for p, pair in enumerate(pairs):
        at.setdefault(tuple(pair), []).append(p)
    n_left += -n_left % width
    none = F.array().cast("array<int>")
    table = [F.array(*map(F.lit, at[i, j])) if (i, j) in at else none for i in range(n_left) for j in range(n_right)]
    own = (F.col("_g") * width + F.col("slot")) * n_right + F.col("_r")
    return F.when(F.col("_r") < n_right, F.get(F.array(*table), own))
