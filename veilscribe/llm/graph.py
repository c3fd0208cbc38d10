"""Connected components of a graph given by its edges, as joins and aggregations.

Large-star and small-star in turn (Kiveris et al., Connected Components in MapReduce and
Beyond, 2014): every node is hung on the least node next to it until each component is a
star around its least node.  Each round is written out; nothing is gathered anywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm.store import Workspace


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` of each ``key`` as ``name``, null if it has none.

    Rows of a key are dealt out by a salt, and what is known of the key goes to each salt
    that it has, so that a key with a third of all rows is no task of its own.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "__salt").agg(F.min(value).alias("__least"))
    whole = parts.groupBy(F.col(key).alias("__key")).agg(F.min("__least").alias(name), F.collect_list("__salt").alias("__salts"))
    known = whole.select("__key", name, F.explode("__salts").alias("__of"))
    return salted.join(known, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__of"))).select(*rows.columns, name)


def _hung(pairs: DataFrame) -> DataFrame:
    """u, v, m: pairs with the least of u and all v beside it."""
    return with_least(pairs, "u", "v", "m").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hung(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _hung(down)
    return hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, space: Workspace, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root for every node of an edge: the least node it can reach.  Loops and repeated edges do no harm.

    Node ids are of any type that sorts.  Raises RuntimeError if ``rounds`` do not
    suffice; a round about squares the reach, so that this needs absurd graphs.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct()
    before, name, run = None, None, uuid.uuid4().hex
    for k in range(rounds):
        last, name = name, f"stars-{run}-{k}"
        now = space.table(_small_star(_large_star(now)), name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last:
            space.drop(last)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components were not found in {rounds} rounds")
