"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns rows; each is written as Parquet and read
again as the next one's input.  All but the last return the columns of their input, so extra
columns go through to the end.

Defined cases: a null text is judged and encoded as an empty one; empty texts are linked with nothing and
stay; rows without an id have no component, so near-dedup keeps none of them; rows that share an
id are judged each by its own text in stages 1, 2 and 4, and are one document in stage 3; exact repeats
of a row stay together, since they are one class under one id; null columns pass through; an empty
table gives no rows.  A text is one value of its stage: those of about 100 MB and more don't fit
executors of 3 GB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.llm import bpe, decontaminate, near_dedup, substring_dedup, toxicity
from newsprism.llm.columns import BOX, Columns
from newsprism.llm.queries import table, vocabulary
from newsprism.storage import stored

#: The minhashes of a near-duplicate stage and the confirmation can't be said in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier go; texts that lose none stay as they are, and n_chars
    follows the text."""
    own = Columns(docs, moved=["text"])
    out = substring_dedup.dedup_substrings(own.rows(doc_id=own["doc_id"], text=own["text"]))
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(cut, F.length("kept_text").cast(kind)).otherwise(F.col(f"{BOX}.{own.find('n_chars')}"))
    return own.back(out, **new)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule condemns go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with n_tokens, ids and the text they decode to."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
