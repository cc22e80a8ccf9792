"""The queries of this package, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, fertility, katz, langid, lines, packing, quotes, repair, simhash, substrings, trie, warc
from folioscope.llm.common import id_remainder, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derive(warc.responses(read(spark, sf_dir, "pages")))


@query
def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", id_remainder(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.filter(~F.col("held_out")))
    found = docs.select("doc_id", "held_out", langid.predictions(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = fertility.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("fertility")
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rest = ["n_tokens", "chars_per_token", "byte_share", "entropy", "script"]
    return judged.select("row.doc_id", *[m[c].alias(c) for c in first + rest])


@query
def op4_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op6_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier place has."""
    left = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("lines.text"), F.lit(""))
    return left.select("row.doc_id", "lines.n_lines", "lines.n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


@query
def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("items")


@query
def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it answers, in reply order."""
    return quotes.reply_order(read(spark, sf_dir, "conversations"))


@query
def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes that also start elsewhere."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


@query
def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under a model of six sevenths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.scores(docs, id_remainder(F.col("doc_id"), 7) == 2)


@query
def op13_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    coded = bpe.encode(read(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt on the first turns of others."""
    return trie.rebuilt_trie(read(spark, sf_dir, "conversations"), lambda conv: id_remainder(conv, 9))


@query
def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    conversations = read(spark, sf_dir, "conversations")
    return repair.audit_and_digest(repair.damage(conversations), conversations)
