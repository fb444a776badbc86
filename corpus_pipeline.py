"""Documents to training tokens, in five stages: quality classifier, toxicity, near-duplicates, mixing, byte-level BPE.

Each stage takes what its predecessor kept, as a table in the shared folder. All but the last return the columns of documents, whatever
others there are beside doc_id, text, lang and source; the last returns doc_id and what its encoding holds, and no lang or source.

Texts that are null or empty go in the first stage. A row without doc_id has no label, passes the near-duplicate stage as it is, and is drawn by its
text's hash in the mix. Repeated rows of a document that is kept all stay, and are taken equally often. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import bpe, minhash, mixing, quality, store, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _labels(spark, sf_dir))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir).filter(~toxicity.held_out())
    return toxicity.clean(docs, toxicity.train(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *bpe.multilingual())


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near-duplicates", one_of_each),
    ("mixing to target weights", to_weights),
    ("byte-level BPE", to_tokens),
]

#: Training, connected components and tokenization aren't SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), "stage")
    return docs
