"""Places of rows within groups that may be as large as the table: no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_BLOCK = 100_000


def placed(rows: DataFrame, keys: list[str], pos: str, name: str, per_block: int = PER_BLOCK) -> DataFrame:
    """``rows`` with ``name``: each row's place from 1 within its group, by the number ``pos``, which is unique in a group.

    Rows are counted by blocks of ``pos``; a row's place is its place in its block plus what the blocks before hold.
    Null keys are a group like any other.
    """
    flat = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__k{i}") for i, k in enumerate(keys)] + [F.col(k).isNull().alias(f"__n{i}") for i, k in enumerate(keys)]
    own = [f"__k{i}" for i in range(len(keys))] + [f"__n{i}" for i in range(len(keys))]
    blocks = rows.select("*", *flat, F.floor(F.col(pos) / per_block).alias("__block"))
    sizes = blocks.groupBy(*own, "__block").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*own).orderBy("__block")  # one row per block
    before = sizes.select(*own, "__block", (F.sum("__n").over(group) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*own, "__block").orderBy(pos))
    out = blocks.withColumn("__in", inside).join(before, [*own, "__block"])
    return out.withColumn(name, F.col("__before") + F.col("__in")).select(*rows.columns, name)
