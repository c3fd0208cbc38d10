"""Mixing sources to target weights by Poisson replication.

A source's mean repetition is its target share of the whole over its own share.  Each
document's number of copies is the Poisson distribution with that mean, inverted at a
uniform number that a hash of seed and id gives: the same on any machine, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm.store import Workspace, free

#: Greater means are split into equal parts, each with a draw of its own; sums of Poisson draws are Poisson.
PART_MEAN = 64.0
_HEX = 13


def _uniform(*parts) -> F.Column:
    """A number in [0, 1) of 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX), 16, 10).cast("long") / F.lit(float(1 << 4 * _HEX))


def means(docs: DataFrame, weights: DataFrame, *, source_col: str = "source", size: F.Column, weight_col: str = "weight") -> DataFrame:
    """source, size, mean: the mean repetition that gives each source its share of the whole size.

    Weights are shares of any scale; null, negative and missing ones are 0, and so is
    the mean of a source of size 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    given = weights.groupBy(F.col(source_col).alias("given")).agg(F.sum(F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"))
    both = sizes.join(given, sizes["source"].eqNullSafe(given["given"]), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    # a row for each source
    total = both.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weights"))
    mean = F.when((F.col("size") > 0) & (F.col("weight") > 0), F.col("weight") / F.col("weights") * (F.col("all") / F.col("size"))).otherwise(0.0)
    return both.join(F.broadcast(total)).select("source", "size", mean.alias("mean"))


def _tables(mean_by_source: DataFrame) -> DataFrame:
    """source, parts, cdf: P(X <= 0), P(X <= 1), ... of one part, as far as a 52-bit number can tell."""
    parts = F.greatest(F.ceil(F.col("mean") / PART_MEAN), F.lit(1)).cast("int")
    rate = F.col("rate")
    last = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    p0 = F.exp(-rate)

    def more(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    grown = F.aggregate(F.sequence(F.lit(1), last), F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf")), more, lambda acc: acc["cdf"])
    return mean_by_source.withColumn("parts", parts).withColumn("rate", F.col("mean") / F.col("parts")).select("source", "parts", grown.alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``docs`` with each row as often as drawn, in a new order all over; added: copy, copies, place.

    ``weights`` has ``source_col`` and ``weight``; sizes are UTF-8 bytes of the texts.
    A null source is a source like any other, a null text has size 0, and a null id draws
    as the string ``null``.  Rows that repeat an id draw the same number.  Sources
    without a weight above 0, or of size 0, come out empty; an empty table stays empty.
    Columns of ``docs`` stay as they are; if one is named like a result, the result has an
    underscore after it.  ``place`` orders the copies: rows of a partition are sorted by it and
    partitions are ranges of it.

    The table of sources is written out first, so that Spark broadcasts it by its known
    size or else joins by a shuffle in which hot sources are split.
    """
    spark = docs.sparkSession
    copy_, copies_, place_, source_, parts_, cdf_ = free(docs.columns, "copy", "copies", "place", "from", "parts", "cdf")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    space = Workspace(spark, "mixing")
    tables = space.table(_tables(means(docs, weights, source_col=source_col, size=size)).coalesce(1), "sources").toDF(source_, parts_, cdf_)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    seeded = F.lit(str(seed))

    def drawn(part):
        return F.size(F.filter(cdf_, lambda c: c <= _uniform(seeded, part.cast("string"), key))).cast("long")

    copies = F.aggregate(F.sequence(F.lit(0), F.col(parts_) - 1), F.lit(0).cast("long"), lambda n, part: n + drawn(part))
    out = docs.join(tables, docs[source_col].eqNullSafe(tables[source_])).withColumn(copies_, copies).filter(F.col(copies_) > 0)
    out = out.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies_)).alias(copy_), copies_)
    out = out.withColumn(place_, F.conv(F.substring(F.md5(F.concat_ws("|", seeded, F.lit("place"), key, F.col(copy_).cast("string"))), 1, _HEX), 16, 10).cast("long"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(n, F.floor(F.col(place_) / float(1 << 4 * _HEX) * n).cast("int")).sortWithinPartitions(place_, copy_)


def tempered(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", power: float = 0.5) -> DataFrame:
    """Weights that flatten the sources: the size of each to ``power``."""
    size = F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"))
    return docs.groupBy(source_col).agg(F.pow(size.cast("double"), F.lit(power)).alias("weight"))
