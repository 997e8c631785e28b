"""Running values over the rows of documents, also of documents that many tasks share.

Rows of an ordinary document meet in one task and windows run over them. A document that
is dealt has its rows in blocks of as many as its column ``dealt`` says. A block is summed
up in one row, windows over those few rows tell with what each block is entered and left,
and the windows of the block go on from there. Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.scratch import written

#: Documents of more characters are dealt over tasks, in blocks of so many lines, segments or components.
LONG_TEXT = 16 << 20
BLOCK = 16_384


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as a shuffle has: the work to come is far more than their bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_length(documents: DataFrame, work: Callable[[DataFrame, bool], DataFrame], long_text: int = LONG_TEXT, block: int = BLOCK) -> DataFrame:
    """``work(rows, dealt)`` over ordinary documents and over long ones, as one table with a column ``dealt``.

    Whether there are long ones is asked first, which reads the texts once more but splits nothing.
    """
    n_chars = F.coalesce(F.length("content"), F.lit(0))
    long = documents.where(n_chars > long_text)
    mark = lambda rows, size: rows.withColumn("dealt", F.lit(size).cast("int"))
    if long.isEmpty():
        return mark(work(mark(documents, None), False), None)
    # Marked again on top, so that a filter on the mark leaves one of both plans.
    short = mark(work(mark(documents.where(n_chars <= long_text), None), False), None)
    return short.unionByName(mark(work(mark(long, block), True), block))


def running(
    rows: DataFrame, order: str, dealt: bool, last: Mapping[str, Column] = {}, total: Mapping[str, Column] = {}, following: Mapping[str, Column] = {},
) -> DataFrame:
    """Adds columns by each document's ``order``, a number from 0 or 1 without gaps.

    ``last``: the last value that is not null in the rows before; ``total``: the sum
    through this row; ``following``: the next row's value, null for the last row.
    """
    if not dealt:
        by = Window.partitionBy("document_id").orderBy(order)
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        through = by.rowsBetween(Window.unboundedPreceding, 0)
        found = {n: F.last(x, ignorenulls=True).over(before) for n, x in last.items()}
        return rows.withColumns(found | {n: F.sum(x).over(through) for n, x in total.items()} | {n: F.lead(x).over(by) for n, x in following.items()})

    stored = written(rows.withColumn("block", F.floor(F.col(order) / F.col("dealt"))), "dealt")
    sums = [F.max_by(x, F.when(x.isNotNull(), F.col(order))).alias(f"last_{n}") for n, x in last.items()]
    sums += [F.sum(x).alias(f"total_{n}") for n, x in total.items()] + [F.min_by(x, order).alias(f"following_{n}") for n, x in following.items()]
    blocks = Window.partitionBy("document_id").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    ends = stored.groupBy("document_id", "block").agg(*sums).select(
        "document_id", "block", *(F.last(f"last_{n}", ignorenulls=True).over(earlier).alias(f"last_{n}") for n in last),
        *(F.coalesce(F.sum(f"total_{n}").over(earlier), F.lit(0)).alias(f"total_{n}") for n in total), *(F.lead(f"following_{n}").over(blocks).alias(f"following_{n}") for n in following),
    )
    by = Window.partitionBy("document_id", "block").orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    through = by.rowsBetween(Window.unboundedPreceding, 0)
    at_end = F.lead(F.lit(1)).over(by).isNull()
    found = {n: F.coalesce(F.last(x, ignorenulls=True).over(before), f"last_{n}") for n, x in last.items()}
    found |= {n: F.sum(x).over(through) + F.col(f"total_{n}") for n, x in total.items()}
    found |= {n: F.when(at_end, F.col(f"following_{n}")).otherwise(F.lead(x).over(by)) for n, x in following.items()}
    return stored.join(ends, ["document_id", "block"]).withColumns(found).select(*rows.columns, *found)
