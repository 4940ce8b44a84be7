"""Corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; all but the last return the columns of
documents. Stages are written as Parquet and read again, so that a stage's
work is done once and lost executors cost no more than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import entries, mixing, ngram_join, quality, toxicity
from gridloom.llm.common import cut, shared_dir, table

MIX = ("slot", "place", "in_mix")
#: Slots after which the mix repeats: the driver works out these alone, however many rows there are.
PERIOD = 262_144
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; the model learns from this stage's own documents.

    Null and empty texts score as an empty text, very long ones are scored
    whole; repeated rows and rows with equal scores fare alike, whatever their
    id; a null id, source, lang or n_chars changes nothing; extra columns stay,
    whatever their names; without labels all score the share of ones, 0.5
    without any, and stay; an empty table stays empty.
    """
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity.

    Null and empty texts have no sentence, score 0 and stay; very long texts
    are scored whole; repeated rows fare alike; nulls in other columns change
    nothing; extra columns stay, whatever their names; without labels of both
    kinds all stay; an empty table stays empty.
    """
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near duplicates.

    Null and empty texts, and texts without words, are alone and stay, repeated
    rows of them too; very long texts are compared whole; of rows that repeat
    an id and a text one stays; rows with a null id take part and stay only
    where no row of their group has an id, then one of them; other columns may
    hold nulls and have any names; an empty table stays empty.
    """
    return ngram_join.first_of_each(docs)


def in_mix_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: by the slot of their block, so that any stretch of the files keeps the target weights.

    No row goes; a source that has run out leaves its slots empty. A null source is a source of its own; rows with null or
    repeated ids get places by their other columns, and rows alike in all
    columns are interchangeable; columns named as the mix's own stay as they
    were; an empty table stays empty.
    """
    return mixing.interleaved(docs, period=PERIOD)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of what they decode to, with each row's slot and place in the mix; both follow from the rows, so they are those of the stage before.

    A row for every row: null and empty texts have no ids and the digests of no
    bytes; very long texts are cut into chunks and stitched; repeated rows and
    null ids get a row each; columns of the input other than the id are left
    behind; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "source", mixing.hash_of_all(docs).alias("__deal"))
    found = cut(entries._encoded(rows, ("source", "__deal")))  # texts are read once and move nowhere; digests get their places
    return mixing.mix(found, period=PERIOD, deal_by=F.col("__deal")).select(*entries.DIGESTS, *MIX)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("mixing", in_mix_order),
    ("tokens", tokens),
]

#: Two stages learn their models, which SQL can't express; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's digests, in the order of the mix."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/gridloom-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs.orderBy("slot", "place").drop(*MIX)
