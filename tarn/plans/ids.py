"""Dense identifiers in sort order, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.plans.session import cut

ROW_BITS = 33  # monotonically_increasing_id: partition above these bits, row below


def dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """`df` with `name` = start, start+1, ... in the order of the columns `order`.

    A range exchange sorts the rows; each partition numbers its own and the partitions' counts give
    the offsets. Only those counts, one per partition, reach the driver. The sorted rows are
    checkpointed, since range bounds come from samples and a second run could cut elsewhere.
    Ties get ids in an order that is not defined; make `order` unique where it matters.
    """
    taken = {c.lower() for c in df.columns}
    row, part = "_row", "_part"
    while row in taken or part in taken:
        row, part = row + "_", part + "_"
    numbered = F.monotonically_increasing_id()
    sorted_rows = cut(
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn(row, numbered)
    )
    position: Column = F.col(row).bitwiseAND((1 << ROW_BITS) - 1)
    counts = (
        sorted_rows.groupBy(F.shiftright(row, ROW_BITS).alias(part)).agg(F.count("*").alias("n")).collect()
    )
    if not counts:
        return sorted_rows.withColumn(name, F.col(row)).drop(row)
    offsets, total = [], start
    for r in sorted(counts, key=lambda r: r[part]):
        offsets.append((r[part], total))
        total += r["n"]
    # one row a partition, so small enough to be broadcast
    table = sorted_rows.sparkSession.createDataFrame(offsets, f"{part} long, {name}_ long")
    placed = sorted_rows.withColumn(part, F.shiftright(row, ROW_BITS)).join(F.broadcast(table), part)
    return placed.withColumn(name, F.col(f"{name}_") + position).drop(row, part, f"{name}_")
