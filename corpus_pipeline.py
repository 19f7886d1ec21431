"""Corpus pipeline over `documents`: toxicity filter, line de-duplication, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes every stage's result as Parquet in the shared folder and hands what it reads back to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import toxicity
from lexspan.llm.common import Workspace, scratch
from lexspan.llm.lines import dedup_lines
from lexspan.llm.mixing import mixture
from lexspan.llm.packing import pack
from lexspan.llm.queries import vocabulary
from lexspan.llm.simhash import keep_one


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus's labels, doesn't reject. Null and empty texts have the score of
    a text without words; repeated rows go or stay together; all columns pass through, whatever their names."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay; a null text that lost nothing stays null, n_chars follows the text. Rows that
    repeat a doc_id are one document; a null doc_id comes after all others; all columns pass through, whatever their names."""
    lines = dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    replaced = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return lines.select(*[replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Null, empty and wordless texts are one group;
    a null doc_id comes after all others, and a group without any stays whole; rows that repeat doc_id and text stay or go
    together; no rows give no rows; all columns pass through, whatever their names."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's target takes them, the last one cut at the budget's last word. Texts
    without words (null ones too) are taken no time; a null source is a source of its own; repeated rows are documents of
    their own; no rows give no rows; all columns pass through, whatever their names, and n_chars follows the text."""
    return mixture(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents in sequences of 1024 ids; a repeated document is packed as often as it is there.
    Null and empty texts are their end id alone; null ids and sources stay null; other columns are not read."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_tokens),
]

#: A fitted classifier, XXH64 fingerprints and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage staged for itself goes once its result is written, and so does the result before."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = ws.stage(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            ws.drop(f"stage-{number - 1}")
    return docs
