"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm.audit import mask_counts, order_effects
from noteweave.llm.binary import materialise, read_slots
from noteweave.llm.centroids import cluster
from noteweave.llm.langid import fit, identify
from noteweave.llm.linedup import dedup_lines
from noteweave.llm.mixing import Weights, mix
from noteweave.llm.oracles import AUDIT, TOP_K, URL_FILTERS, cluster_sql, mix_sql
from noteweave.llm.packing import pack
from noteweave.llm.quality import score, train
from noteweave.llm.simhash import near_duplicates
from noteweave.llm.sketch import containment, fingerprint_text, fingerprints_with_edits, resemblance
from noteweave.llm.storage import new_folder
from noteweave.llm.tokencount import count_tokens
from noteweave.llm.topk import top_k
from noteweave.llm.urlrules import Rule, judge, place_rule
from noteweave.session import configure
from noteweave.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"

#: The tree's first level, as SQL over documents.
DOMAIN = (
    "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'web' "
    "WHEN source IN ('src3', 'src4', 'src5', 'src6', 'src7', 'src8') THEN 'books' ELSE 'reference' END"
)
MIX_SHARE = 0.8
MIX_WEIGHTS = Weights(domain={"web": 2, "books": 5, "reference": 3}, lang={"en": 6, "de": 2}, source={"src0": 1, "src4": 3})

URL_RULES = [
    place_rule("allow", "org/"),
    place_rule("block", "example.org/es/"),
    place_rule("block", "example.org/en/1"),
    place_rule("allow", "com/fr/"),
    place_rule("block", "com/de/"),
    Rule("advertising hosts", "block", r"^(?:[^/]*\.)?ads\.", ("ads",)),
    Rule("login pages", "block", r"/(?:account/)?login(?:/|$)", ("login",)),
]


def op1_pack_binary(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(read_table(configure(spark), folder, "documents"), public_tokenizers.path(TOKENIZER), longest=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = count_tokens(read_table(configure(spark), folder, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(read_table(configure(spark), folder, "documents"), domain=DOMAIN, share=MIX_SHARE, weights=MIX_WEIGHTS, max_epochs=4, seed=7)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken")


def op3_top_k_bitsliced(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(read_table(configure(spark), folder, "embeddings"), 5, F.col("vec_id") % 50 == 0, scale=256)


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(configure(spark), folder, "documents"), distance=4, words=4, seed=42)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    deduped = dedup_lines(read_table(configure(spark), folder, "documents"))
    return deduped.select("doc_id", "text", "n_lines", "n_deleted")


def op6_training_order(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    out = new_folder(spark, "training-order")
    layout = materialise(read_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), out, ids=2048, per_shard=4096, seed=11)
    stands = read_slots(spark, out, layout).select("slot", "shard", "offset", F.crc32("record").alias("ids_crc32"))
    return stands.join(spark.read.parquet(f"{out}/index"), "slot").select("slot", "shard", "offset", "ids_crc32", "doc_id", "start", "n_ids")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(configure(spark), folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    filters = fit(docs, ~held_out)
    return identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_threshold_sketch(spark: SparkSession, folder: str) -> DataFrame:
    edits = fingerprints_with_edits(read_table(configure(spark), folder, "documents"))
    return edits.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("sketch")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("held_by_next"),
    )


def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read_table(configure(spark), folder, "pages"), URL_RULES, otherwise="allow")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return order_effects(mask_counts(read_table(spark, folder, "documents"), read_table(spark, folder, "labels")))


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(read_table(configure(spark), folder, "embeddings"), k=8, rounds=10, dimensions=64, scale=1024, seed=3)


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(configure(spark), folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    judged = score(docs, train(docs, read_table(spark, folder, "labels"), ~held_out))
    return judged.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_binary, op2_mix_sources, op3_top_k_bitsliced, op4_simhash_near_dedup, op5_line_dedup,
        op6_training_order, op7_language_id, op8_threshold_sketch, op9_url_filters, op10_token_counts,
        op11_filter_audit, op12_centroid_clusters, op13_quality,
    )
}

#: SimHash, tokenizers, sketches and learnt models have no SQL; those queries are tested against plain Python.
LLM_ORACLES = {
    "op2_mix_sources": mix_sql(DOMAIN, MIX_SHARE, MIX_WEIGHTS, 4, 7),
    "op3_top_k_bitsliced": TOP_K,
    "op9_url_filters": URL_FILTERS,
    "op11_filter_audit": AUDIT,
    "op12_centroid_clusters": cluster_sql(k=8, rounds=10, dimensions=64, scale=1024, seed=3),
}
