"""Row-position windows over long series without putting a whole series in one task.

A plain ``Window.partitionBy(ticker)`` sends every row of a ticker to one task; with one ticker holding
a third of the data that task is the whole job. Instead:

1. ``series_index`` numbers the rows of each series 0, 1, 2, ... in two levels. Rows are cut into time
   chunks (``date_trunc(chunk_unit, ts)``; bars are unique per interval, so a chunk holds a bounded
   number of rows). A row number inside (key, chunk) plus the running total of earlier chunks' row
   counts gives the position. The running total is a window over the chunk-count table, which is
   smaller than the series by the chunk size.
2. ``with_reach`` cuts the numbered rows into blocks of ``block_rows`` consecutive positions and copies
   the last ``reach`` rows of each block into the next one as read-only context. A frame reaching at
   most ``reach`` rows back is then complete inside (key, block); context rows are dropped after the
   window functions run. Extra data: ``reach / block_rows`` of the input.

Both steps are exact; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 50_000

BLOCK = "_blk"
CONTEXT = "_ctx"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def series_index(df: DataFrame, key: str | Sequence[str], order: str, chunk: Column,
                 idx: str = "idx") -> DataFrame:
    """Add ``idx``: 0-based position of each row in its series, ordered by ``order``.

    ``order`` must be unique within a series; ``chunk`` must be non-decreasing in ``order``.
    """
    keys = _keys(key)
    chunked = df.withColumn("_chunk", chunk)
    local = chunked.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    return (local.join(offsets, [*keys, "_chunk"])
            .withColumn(idx, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
            .drop("_chunk", "_rn", "_off"))


def with_reach(indexed: DataFrame, reach: int, idx: str = "idx",
               block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Add block and context columns so a frame of ``reach`` rows back is whole per block."""
    if reach > block_rows:
        raise ValueError(f"reach {reach} exceeds block_rows {block_rows}")
    own = F.expr(f"{idx} div {block_rows}")
    # A row is context for the next block when its reach crosses the block boundary.
    blocks = F.when(F.expr(f"({idx} + {reach}) div {block_rows}") > own, F.array(own, own + 1)).otherwise(F.array(own))
    spread = indexed.withColumn(BLOCK, F.explode(blocks))
    return spread.withColumn(CONTEXT, F.col(BLOCK) > own)


def block_window(key: str | Sequence[str], idx: str = "idx"):
    return Window.partitionBy(*_keys(key), BLOCK).orderBy(idx)


def drop_context(df: DataFrame) -> DataFrame:
    return df.where(~F.col(CONTEXT)).drop(BLOCK, CONTEXT)


def rolling(df: DataFrame, key: str | Sequence[str], order: str, chunk: Column, reach: int,
            columns, block_rows: int = DEFAULT_BLOCK_ROWS, idx: str = "idx") -> DataFrame:
    """Apply window columns whose frames reach at most ``reach`` rows back.

    ``columns(w)`` receives the per-block window spec (partition + order, no frame) and returns a
    dict ``name -> Column``; the result keeps every input row exactly once, plus ``idx``.
    """
    staged = with_reach(series_index(df, key, order, chunk, idx), reach, idx, block_rows)
    w = block_window(key, idx)
    out = staged.select("*", *[c.alias(n) for n, c in columns(w).items()])
    return drop_context(out)
