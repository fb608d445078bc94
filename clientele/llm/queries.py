"""Registered queries of the operators: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import alignment, bpe, chat, licenses, lines, mixing, near_dups, quality, repair, reputation, rules, secrets, winnowing
from clientele.llm.common import read
from clientele.sources.staging import staged


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its number: bad if of low quality or toxic."""
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return reputation.judge_urls(read(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, numerator=85, denominator=100)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.line_report(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.array_join("deleted", ",").alias("deleted"),
                       F.sha2(F.col("text"), 256).alias("text_sha256"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = winnowing.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return done.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                       F.sha2(secrets.listed(of("assign", "access", "hex")), 256).alias("base_sha256"),
                       secrets.listed(F.col("found")).alias("spans"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.documents_as_files(read(spark, sf_dir, "documents"))
    return licenses.scan_licenses(files, F.lit(False), mostly=licenses.MOSTLY).withColumnRenamed("file", "doc_id")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


CONTROL = (-7, "\\### Assistant: </turn> ok")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, as read back from the output."""
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(CONTROL[0], i, role, CONTROL[1]) for i, role in enumerate(("user", "assistant"))],
                                    "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(table.unionByName(control))
    turns = chat.read_back(F.col("formatted"))
    loss = F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "")
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(F.col("conv").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligner = alignment.Aligner.of(alignment.ByteLevel.read(public_tokenizers.path("byte_bpe_50k.json")),
                                   alignment.Pieces.read(public_tokenizers.path("piece_bpe_32k.model")))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = staged(alignment.align(read(spark, sf_dir, "documents"), aligner).select("doc_id", "n_a", "n_b", digest, "links"))
    return alignment.with_link_scores(aligned, aligner).select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut short, repeated or given to the user, as the hash of their number says."""
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    hit = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return (turns.filter(hit != 0)
            .select("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"),
                    F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    F.explode(F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1))).alias("copy")).drop("copy"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conversation; one that lost all rows has nothing to repair."""
    turns = read(spark, sf_dir, "conversations")
    done = repair.repair_conversations(damaged(turns))
    every = turns.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


QUERIES = {
    "op1_url_filters": url_filters,
    "op2_minhash_near_dedup": minhash_near_dedup,
    "op3_line_dedup": line_dedup,
    "op4_quality_rules": quality_rules,
    "op5_quality_classifier": quality_classifier,
    "op6_decontamination": decontamination,
    "op7_secret_scan": secret_scan,
    "op8_license_scan": license_scan,
    "op9_source_mixing": mix_sources,
    "op10_chat_format": chat_format,
    "op11_token_alignment": token_alignment,
    "op12_byte_bpe": byte_bpe,
    "op13_conversation_repair": conversation_repair,
}
