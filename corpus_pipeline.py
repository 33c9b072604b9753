"""A training-corpus pipeline over ``documents``: each stage reads what its predecessor wrote.

All stages but the last return the columns of documents, whatever further ones there are and however they are named; ``n_chars`` follows the text where a
stage changes it. Every stage takes an empty table and gives one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookflow.llm import language_ppm, line_alignment, mixing, packing
from hookflow.llm.common import PIECE_BYTES, fresh, packed as as_struct, table, unpacked, written
from hookflow.llm.ngram_jaccard import jaccard_groups
from hookflow.llm.queries import tokenizer_path

# A text whose winning language has less than this share of the probability is not told from another language.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_batches(stage: Stage) -> Stage:
    """The stage, with rows handed to Python and back in Arrow batches of ``PIECE_BYTES``. Spark's own limits, 10,000 rows and 64 MB, make one batch of a whole
    partition, which JVM and Python hold several times over. What a stage returns runs after it, so the session keeps the setting."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay; those without letters, between languages, or in none that was learned, go.

    Null, empty and letterless texts go. A null doc_id or lang teaches nothing, but its text is judged like any other; repeated rows share a verdict. Without
    any labelled row no language is known and none stays.
    """
    model = language_ppm.fit(docs)
    most = language_ppm.limits(docs, model)
    lang, score, bits = fresh(docs.columns, "__lang_pred", "__score", "__bits")
    found = language_ppm.predict(docs, model, lang, score, bits)
    told = (F.col(lang) != language_ppm.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)
    for name, limit in most.items():
        told &= (F.col(lang) != name) | (F.col(bits) <= limit)
    return found.where(told).drop(lang, score, bits)


@in_batches
def without_shared_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines shared with earlier documents are cut; documents of which no word is left go.

    Documents are earlier by doc_id (null last), then by a hash of their text. Null, empty and blank texts stay as they are; repeated rows are cut alike.
    """
    kept, total, removed = fresh(docs.columns, "__kept", "__total", "__removed")
    found = line_alignment.dedup_lines(docs, kept, total, removed)
    changed = F.col(removed) > 0
    left = found.where(~changed | F.col(kept).rlike(mixing.WORD))
    return _with_text(left, docs.columns, F.col(kept), changed)


@in_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one document stays: that with the smallest doc_id, null last, and then the smallest hash of its text.

    Texts of one doc_id are judged each for itself. Texts without a word stand alone and stay. Rows that repeat doc_id and text are one.
    """
    groups = jaccard_groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    best = groups.where("comp is not null").groupBy("comp").agg(F.min(order).alias("best")).select("best.doc_id", "best.tie")
    alone = groups.where("comp is null").select("doc_id", "tie")
    chosen = best.unionByName(alone).distinct().select(F.col("doc_id").alias("kept_id"), F.col("tie").alias("kept_tie"))
    text = F.col("text").cast("string")
    rows = docs.select(as_struct(docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("tie"))
    # The hash is never null, so no row without a doc_id meets all others of its kind in one task.
    left = rows.join(chosen, (F.col("tie") == F.col("kept_tie")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return unpacked(left.dropDuplicates(["id", "tie"]))


@in_batches
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken in two epochs comes twice.

    A null source is a source. Texts without a word are never taken. The last document of a budget is cut to the words that fit; of equal rows any may be the one.
    """
    return _with_text(mixing.mixed(docs), docs.columns, F.col("text"), F.lit(True))


@in_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. A null or empty text is one piece with the end token; repeated rows are packed as often as they come."""
    return packing.pack(docs, tokenizer_path())


def _with_text(docs: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """The columns of documents, with the text and, where it was changed, its number of characters."""
    count = F.when(changed, F.char_length(text).cast("long"))
    own = {"text": text, "n_chars": F.coalesce(count, F.col("n_chars")) if "n_chars" in columns else None}
    return docs.select(*(own[c].alias(c) if own.get(c) is not None else F.col("`" + c.replace("`", "``") + "`") for c in columns))


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_shared_blocks),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed),
]

# Hash orders, code lengths and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents table: one row for each piece that the last stage packs. Each stage's rows are written and read again, so a lost
    executor costs no more than a task of the stage that runs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
