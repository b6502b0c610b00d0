"""The corpus pipeline: documents through five stages, each written and read again.

Quality rules drop what they reject, near-duplicates keep one document of each
group, decontamination drops contaminated documents, secret scans redact what they
find, and the last stage encodes the texts. Every stage works on all that the one
before kept; all but the last return the columns of documents.

Counted as part of ``basalt.llm``. Defined results: every row is judged by itself, under
a number that the stage gives it, so null and repeated doc_ids are dropped like others;
of a group of near-duplicates the row of the smallest doc_id stays (null after all
others), of equal rows any one; null and empty texts go in the first stage; an empty
table, or a stage that keeps nothing, gives an empty result; other columns than those of
documents are left behind, whatever their names; very long texts are taken whole. The
folders of the stages go when the application ends.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import passing, pick, shared_dir, ship, table, written
from basalt.llm.decontaminate import decontaminate
from basalt.llm.near_dedup import near_dedup
from basalt.llm.piece_codec import encode_pieces
from basalt.llm.quality_rules import quality_rules
from basalt.llm.secret_scan import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number of its own for each row, null and repeated doc_ids too. Written, so that numbers stay when a task is run again."""
    return written(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows without those of the dropped numbers. The list is written, so that both sides of the join are exchanged alone."""
    return rows.join(written(dropped.select("row"), "dropped"), "row", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules(docs, keep=COLUMNS, language="lang")
    return judged.where("kept").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _numbered(docs)
    # Members of groups of two and more: those that aren't the smallest number of theirs, and these.
    others = written(near_dedup(rows, key="row").where(~F.col("kept")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "others")
    members = others.unionByName(others.select(F.col("group").alias("row"), "group").distinct()).join(rows.select("row", "doc_id"), "row")
    # The row of the smallest doc_id stays; null comes after all ids.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stays = members.groupBy("group").agg(F.min(order)["row"].alias("row"))
    return _without(rows, members.join(stays.select("row"), "row", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    judged = decontaminate(rows, table(spark, sf_dir, "benchmark"), key="row")
    return _without(rows, judged.where("contaminated").select(F.col("doc_id").alias("row")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # n_chars follows the text.
    return redact_secrets(pick(docs, *COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode_pieces(docs, MODEL, keep=("doc_id", "lang", "source")).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: The encoding stage can't be expressed in SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        passing(spark, folder)
        docs = spark.read.parquet(folder)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
