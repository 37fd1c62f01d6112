"""Documents to packed training sequences: five stages, each written and read again.

Every stage works on all rows its predecessor kept, and all but the last return the columns of
documents.  A stage's input may hold nulls, repeated rows and extra columns; the columns of documents are what it passes on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.langid import fit, identify
from noteweave.llm.linedup import dedup_lines
from noteweave.llm.mixing import mix
from noteweave.llm.packing import pack
from noteweave.llm.queries import DOMAIN, MIX_WEIGHTS, TOKENIZER
from noteweave.llm.simhash import similar_documents
from noteweave.llm.storage import new_folder
from noteweave.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a text's n-grams that its language must explain.
LEAST_SCORE = 0.3
#: Share of the tokens kept by the mixture; no document is read twice after the near duplicates were removed.
SHARE, EPOCHS = 0.8, 1


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and those that no learnt language explains.

    The filters learn from the labelled rows of the stage's own input, of the 4096 most frequent labels (``most_languages``).  Where no row has a
    label nothing is learnt, and every text with a letter stays.  A text of a language that occurs without labels only (or behind those
    4096) is held against the others: it goes when none of them explains LEAST_SCORE of it.
    """
    configure(spark)
    filters = fit(docs, F.lit(True))
    if not filters.languages:
        return _documents(docs).where(F.col("text").rlike(r"\p{L}"))
    judged = identify(_documents(docs), filters)
    return _documents(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated blocks from later documents; a document with nothing left but blanks goes.

    n_chars is that of the text that stays.
    """
    configure(spark)
    deduped = dedup_lines(_documents(docs)).withColumn("n_chars", F.length("text").cast("long"))
    return _documents(deduped.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines"))))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones (0.8 or more of their sets of five-word shingles).

    It is the one with the smallest doc_id, in a group without any the one with the smallest hash of its text.  Of rows
    equal in doc_id one stays.
    """
    configure(spark)
    classes = similar_documents(_documents(docs), similarity=0.8, words=5)
    named = classes.where("doc_id = component_id")
    nameless = classes.where("component_id IS NULL").groupBy("component").agg(F.min("text_hash").alias("text_hash"))
    heads = named.groupBy("component", "doc_id").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash").union(nameless.select(F.lit(None).cast("long"), "text_hash")).distinct()
    heads = heads.select(F.col("doc_id").alias("head"), F.col("text_hash").alias("head_hash"))
    hashed = _documents(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = hashed.join(heads, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("text_hash") == F.col("head_hash")), "left_semi")
    return _documents(kept.dropDuplicates(["doc_id", "text_hash"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes to the target weights, whole.

    The one that a leaf's prefix cuts is kept whole too, so a leaf passes its budget by less than that document's tokens.  Null lang or
    source form a leaf of their own; null and empty texts have no tokens and go.  Repeated rows are read as often as they occur, equal doc_ids stand
    next to each other in the order, the shorter first.  An empty table stays empty.
    """
    configure(spark)
    return _documents(mix(_documents(docs), domain=DOMAIN, share=SHARE, weights=MIX_WEIGHTS, max_epochs=EPOCHS, seed=7))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of every document that is left: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    A null or empty text is a document of the end id alone.  Rows with a null or repeated doc_id are packed like any other, each by itself.  An empty
    table gives no pieces.
    """
    configure(spark)
    pieces = pack(docs, public_tokenizers.path(TOKENIZER), longest=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: The stages hold a learnt model, SimHash and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out = None
    for name, stage in STAGES:
        out = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
