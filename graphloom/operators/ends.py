"""What tables hold of the nodes that edges end at, without sending wide edges through the network for each end.

Rows of ordinary documents are dealt once, by ``document_id`` alone, before they grow wide;
``beside`` then finds values of both ends by windows that run where the rows are. A
document of more than ``HEAVY`` rows is not put into one task: its edges meet tables by
joins on (document_id, end), which deal them anew.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.scratch import written, written_by

#: Documents of more rows are not put into one task.
HEAVY = 200_000
#: Label of the stored tables.
DEALT = "by-document"
#: Rows that a task gets, about.
TASK_ROWS = 40_000


def dealt(tables: list[DataFrame], heavy: int = HEAVY, task_rows: int = TASK_ROWS, weights: list[Column] | None = None) -> list[tuple[list[DataFrame], int | None]]:
    """Stored tables with a document_id, dealt alike by it, and the number of parts.

    ``weights`` tell of each table for how many rows one of it counts, one unless told.
    They are stored as they were dealt (label ``DEALT``), so that any number of uses, each of other columns,
    shuffles nothing more. If there are heavy documents, the tables of those come as a second item, stored, with None.
    """
    spark = tables[0].sparkSession
    counted = [t.select("document_id", w.cast("long").alias("w")) for t, w in zip(tables, weights or [F.lit(1)] * len(tables), strict=True)]
    rows = functools.reduce(DataFrame.unionByName, counted).groupBy("document_id").agg(F.sum("w").alias("n"))
    counts = rows.agg(F.sum("n"), F.max("n")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(counts[0] or 0) // task_rows))
    near = lambda t: written_by(t, DEALT, "document_id", n)
    if (counts[1] or 0) <= heavy:
        return [([near(t) for t in tables], n)]
    long = written(rows.where(F.col("n") > heavy).select("document_id"), "heavy")
    split = lambda how: [t.join(F.broadcast(long), "document_id", how) for t in tables]
    return [([near(t) for t in split("left_anti")], n), ([written(t, DEALT) for t in split("left_semi")], None)]


def beside(edges: DataFrame, table: DataFrame, value: str, together: bool = False) -> DataFrame:
    """Adds src_<value> and tgt_<value>: what ``table`` (document_id, id, value) has of each end, null if nothing.

    An id stands once in the table. ``together`` says that both are dealt alike by document_id.
    """
    known = table.select("document_id", F.col("id").alias("of"), value)
    if not together:
        for end in ("src", "tgt"):
            edges = edges.join(known.select("document_id", F.col("of").alias(end), F.col(value).alias(f"{end}_{value}")), ["document_id", end], "left")
        return edges
    both = edges.unionByName(known, allowMissingColumns=True)
    for end in ("src", "tgt"):
        same = Window.partitionBy("document_id", F.coalesce("of", end))
        both = both.withColumn(f"{end}_{value}", F.max(value).over(same))
    return both.where("of IS NULL").drop("of", value)
