"""A corpus pipeline over documents: each stage takes what the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of docs.
Rows are told apart by doc_id and text: rows that repeat both stand for one document, and stay or go together. An
empty table stays empty in every stage; columns besides those of documents are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import scratch, table, written
from tidegauge.llm.decontaminate import contaminated
from tidegauge.llm.langid import crc_fold, identify
from tidegauge.llm.mixing import poisson_mix
from tidegauge.llm.simhash import near_duplicates
from tidegauge.llm.suffix_dedup import dedup_substrings


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all but the text in a column `row`, so that an operator's own columns clash with none."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), *names)


def _unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    return df.select(*[new.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns])


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where doc_id also says whether it is null, as such ids come last, and which text it is."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without those whose name, as _named gives it, is the doc_id of a row of gone."""
    names = gone.select("doc_id.doc_id", "doc_id.mark").distinct().toDF("gone_id", "gone_mark")
    return docs.join(names, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_mark")), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (null, no letter, or like no learned language) go. Learns as the query does."""
    known = identify(_packed(docs, "doc_id", "text", "lang"), crc_fold(3) != 1)
    return _unpacked(known.where(~F.col("rejected")), docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 or more on five-word shingles, the document of smallest doc_id stays.

    Of those that share it the one of smaller text hash stays; one without an id stays only in a group without ids. Texts
    without words, null ones too, are one group.
    """
    groups = near_duplicates(_named(docs), width=5, tau=4, least="0.8")
    return _without(docs, groups.where("doc_id <> component_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats an earlier document; those that lose everything go. n_chars follows where it is there."""
    cut = dedup_substrings(_packed(docs, "doc_id", "text"), characters=True)
    text = F.when(F.col("n_removed") > 0, F.decode(F.col("kept"), "UTF-8")).otherwise(F.col("text"))
    kept = cut.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", text)
    new = {}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, size).otherwise(F.col("row.n_chars"))
    return _unpacked(kept, docs.columns, **new)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, exact or edited, go."""
    return _without(docs, contaminated(_named(docs), table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weights; adds rate, copies, replica and shuffle_key."""
    return poisson_mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
]

#: Language models, fingerprints' components and alignments have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and what it wrote on the way is deleted before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = written(stage(spark, docs, sf_dir))
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
