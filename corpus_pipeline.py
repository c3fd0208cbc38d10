"""The corpus pipeline: documents through quality rules, near-dedup, substring dedup, mixing and packing.

Each stage takes what its predecessor kept and returns the columns of documents; the
last returns the pieces of packed sequences.  Null and repeated ids, null texts, empty
tables and extra columns pass through every stage as each says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscribe.llm import fertility, mixing, packing, simhash, substrings
from veilscribe.llm.store import Workspace

#: Near-duplicates: 256 bits over shingles of five words; at most 52 differ, which is a cosine of 0.8 or more between the
#: shingle counts.  Two fingerprints that differ in 52 bits meet with a probability of 0.99
#: at any size of the corpus, nearer ones more often.  Segments are of one bit: with counts of longer ones, a cell for
#: each neighbour and the same recall, a fingerprint would lie in 302 cells instead of 35 at 222,000 fingerprints, and in
#: 3,243 instead of 153 at 10 million.
NEAR = simhash.Sampling(52, words=4, recall=0.99)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands; a null text fails.  Repeated rows are judged alike."""
    judged = fertility.assess(docs, carry=tuple(docs.columns), lang_col="lang" if "lang" in docs.columns else None)
    verdict = fertility.result_names(["doc_id", *(c for c in docs.columns if c != "doc_id")])[6]
    return judged.filter(F.col(verdict)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.  Of rows that repeat an id one stays; rows with a null id cannot be told apart by it and all stay."""
    found = simhash.near_duplicates(docs, shingle_words=5, cover=NEAR)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that an earlier one has; n_chars, if there, is that of the new text.  A null text stays null, and its n_chars is null; of equal rows one keeps its text."""
    cleaned = substrings.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, in a new order, with sources weighted by the square roots of their sizes.

    A null source is a source of its own; one whose texts are all null or empty has no
    size and gives nothing.  Null and empty texts of other sources are drawn like any
    other, and rows that repeat an id are drawn alike, as the draw rests on the id.
    """
    return mixing.mix(docs, mixing.tempered(docs, power=0.5), seed=17).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, 6 segments and 976 tokens after first lines; a document drawn twice is packed twice.

    A null or empty text is its end id alone; null ids stay null, and each row is packed by itself.
    """
    return packing.pack(docs, prompt_mark="\n", length=1024, max_segments=6, max_loss=976, with_ids=False)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing sources", mixing_sources), ("packing", pack)]

#: Tokenisers and hash windows have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = space.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
