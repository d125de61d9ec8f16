"""Dealing of rows to tasks by their size, with one exchange of the rows.

Rows fall into many more slots than there are tasks, by a hash of their key.  A slot's
size is a sum; slots in order, by their cumulative size, make the tasks.  The table
of slots is small by its number of slots, and rows learn their task without moving.
A task is then at most its equal share, one slot and the largest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 64  # for each task


def slot_tasks(rows: DataFrame, key: str, size: Column, tasks: int, slots: int = SLOTS) -> DataFrame:
    """slot, task: which task takes each slot; at most slots x tasks rows."""
    sizes = rows.select(_slot(key, tasks, slots).alias("slot"), size.cast("long").alias("size")).groupBy("slot").agg(F.sum("size").alias("size"))
    # a window over the slots, whose number is a parameter
    order = W.orderBy("slot")
    before = F.sum("size").over(order) - F.col("size")
    total = F.greatest(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(1))
    return sizes.select("slot", F.least(F.floor(before * tasks / total), F.lit(tasks - 1)).cast("int").alias("task"))


def _slot(key: str, tasks: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(tasks * slots)).cast("int")


def dealt_by_size(rows: DataFrame, key: str, size: Column, tasks: int | None = None, slots: int = SLOTS) -> DataFrame:
    """`rows`, with the column `task`, in `tasks` partitions of about equal size, by default as many as there are shuffle partitions.

    A null size counts as none.  The key should be (nearly) unique: rows of one key stay together.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = slot_tasks(rows, key, F.coalesce(size, F.lit(0)), tasks, slots)
    # bounded by slots x tasks rows of two numbers
    return rows.withColumn("slot", _slot(key, tasks, slots)).join(F.broadcast(placed), "slot").drop("slot").repartitionById(tasks, F.col("task"))
