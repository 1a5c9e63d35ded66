"""Pending work from a log of requests: a key is queued once, a removal cancels a queued addition, and the other way round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.mirror import places

ADD, REMOVE = "Add", "Remove"
#: Which class comes first.
CLASSES = {REMOVE: 0, ADD: 1}


def pending(requests: DataFrame) -> DataFrame:
    """key, op, seq, size: what is to be done after requests (seq, key, op, size), one row a key.

    A request of the kind that is queued for its key already is ignored, so that it keeps its place; one of the other kind
    takes the place of the queued one, at the end. So what counts is the last change of kind: the first request after the
    last one of the other kind. The size is that of the key's last request. Null keys are none; other kinds are ignored.

    Keys are brought to two rows each before anything is exchanged, so that a key may have any share of the requests.
    """
    known = requests.where(F.col("key").isNotNull() & F.col("op").isin(*CLASSES))
    last = {op: F.max(F.when(F.col("op") == op, F.col("seq"))) for op in CLASSES}
    ends = known.groupBy("key").agg(last[ADD].alias("_add"), last[REMOVE].alias("_remove"), F.max_by("size", "seq").alias("size"))
    queued = F.when(F.col("_add").isNull() | (F.col("_remove") > F.col("_add")), REMOVE).otherwise(ADD)
    other = F.when(queued == ADD, F.col("_remove")).otherwise(F.col("_add"))
    ends = ends.select("key", queued.alias("op"), "size", F.coalesce(other, F.lit(-1)).alias("_after"))
    # The first request after the other kind's last one: the lasts of all keys, joined to the requests of that kind.
    later = known.select("key", "op", "seq").join(ends, ["key", "op"]).where(F.col("seq") > F.col("_after"))
    return later.groupBy("key", "op", "size").agg(F.min("seq").alias("seq")).select("key", "op", "seq", "size")


def work_order(work: DataFrame) -> DataFrame:
    """work with place, from 1: removals first, in order of seq, then additions, small ones first; numbered by ranges."""
    rank = F.when(F.col("op") == REMOVE, CLASSES[REMOVE]).otherwise(CLASSES[ADD])
    by_size = F.when(F.col("op") == ADD, F.col("size"))
    return places(work.withColumn("_class", rank).withColumn("_size", by_size), [], ["_class", "_size", "seq"]).drop("_class", "_size")
