"""From raw documents to token ids, five stages one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of documents; `n_chars` follows the text. A stage
removes what the stages before wrote to scratch, unless its docs still read it.

Defined results: a null text has no words, so the quality rules drop it; the later stages keep
it, as they keep empty texts. Rows are told apart by id and text: rows of one id (also null)
with different texts are documents of their own, and of rows equal in both one stays
in the near-duplicate stage. Texts of any length are read whole; of equally good copies
the one with the smallest hash stays; an empty table gives an empty table; columns of other
names pass through, and those that a stage uses inside have names with blanks.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import bpe, contamination, lines, neardup, quality
from salesloom.llm.sieve import marked
from salesloom.session import noted, remove, stored

SHINGLE, PERCENT = 5, 80  # of the near-duplicate stage
ROW = "row by id and text"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject."""
    judged = quality.quality(docs, out="quality verdict")
    return judged.where("`quality verdict`.kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and the documents that had nothing else."""
    rest = lines.dedup_lines(docs, out="removed lines")
    rest = rest.where((F.col("removed lines") == 0) | F.col("text").rlike(lines.HAS_WORD))
    return _sized(rest.select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies; rows are decided by id and text."""
    rows = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    found = neardup.near_duplicates(rows.select(ROW, "text"), key=ROW, size=SHINGLE, percent=PERCENT)
    groups = stored(found, "near-duplicate-groups")
    gone = groups.where("not kept").select(ROW).distinct()
    again = groups.where("kept and n_shingles > 0").groupBy(ROW).count().where("count > 1").select(ROW)
    # Only rows that may go or be repeated are shuffled; the others stay where they are.
    asked = marked(rows, gone.unionByName(again), ROW, "asked about")
    rest = asked.where("`asked about`").join(gone, ROW, "left_anti")
    once = rest.join(again, ROW, "left_anti").unionByName(rest.join(again, ROW, "left_semi").dropDuplicates([ROW]))
    return asked.where("not `asked about`").unionByName(once).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = contamination.decontaminate(docs, items, out="benchmark verdict")
    return judged.where("not `benchmark verdict`.contaminated").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text: doc_id, lang, source, n_tokens, ids, same_text."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.public_vocabulary(), decoded="decoded")
    same = F.col("decoded") == F.sha2(F.coalesce("text", F.lit("")), 256)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("same_text"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


_left: dict[str, list[str]] = {}  # by application: scratch of the stages before


def _tidy(stage):
    """The stage, first removing what the stages before left behind."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        kept = remove(spark, _left.pop(app, []), unless_read_by=docs)
        with noted() as paths:
            result = stage(spark, docs, sf_dir)
        _left[app] = kept + paths
        return result

    return run


STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("line dedup", _tidy(line_dedup)),
    ("near duplicates", _tidy(near_duplicates)),
    ("benchmark decontamination", _tidy(decontamination)),
    ("bpe", _tidy(token_ids)),
]
# Token ids are not SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
