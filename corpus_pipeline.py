"""Five stages that make a corpus: toxicity, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import read, stage
from leafmill.llm.jaccard import join_documents
from leafmill.llm.mixing import Mix, mixed_documents
from leafmill.llm.packing import pack_documents
from leafmill.llm.suffixes import dedup_passages
from leafmill.llm.toxicity import score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose predicted label is toxic; all others stay as they are."""
    return score_documents(docs, read(spark, sf_dir, "labels"), carry=True).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group that Jaccard links tie together; of rows of one doc_id and text, one.

    Texts without words link with nothing and stay. Of documents of null doc_id one stays for each text that has no
    near-duplicate of a known doc_id.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    kept = join_documents(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("kept")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"), F.col("text").alias("text"))
    return rows.join(kept, F.col("id") == F.col("kept"), "left_semi").dropDuplicates(["id", "text"]).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; documents of which nothing is left go, those that were empty stay."""
    kinds = dict(docs.dtypes)
    out = dedup_passages(docs, carry=True).where("octet_length(kept_text) > 0 or n_bytes = 0")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return out.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the sources' words by target weights; a document is repeated, or cut to some of its blocks, as the mix says."""
    return mixed_documents(docs, Mix(block=256))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of tokens, the sources in proportion; a row for each piece, with its ids."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("mixing", mixture), ("packing", packing)]

#: The stages need tokenizers, trained models and suffix arrays, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
