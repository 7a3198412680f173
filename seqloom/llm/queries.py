"""Registered queries of the corpus operators, with SQL where SQL can express them.

Each query applies its operator with production parameters to a whole table and derives
the columns of its result from the operator's outputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    chat,
    clustering,
    lines,
    mixing,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash,
    sql,
    substrings,
    suffixes,
    whitening,
)
from .columns import read


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), 8)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return ann.nearest(table, table.where("vec_id % 20 = 0"), 20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"))
    return packed.select(*packing.NAMES, "sequence_id", "offset")


SHOUT = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SHOUT).alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat.format_turns(turns.unionByName(added))
    line = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    shown = F.transform(
        "loss_spans",
        lambda s: chat.unescape(
            F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        ),
    )
    loss = F.array_join(shown, "")
    return done.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    shares = [F.round(F.col("posteriors")[i], 9).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return rated.select("doc_id", "tokens", *shares, F.round("rate", 9).alias("rate"), "copies")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.dedup(read(spark, sf_dir, "documents"))
    spans = F.size("spans").cast("long").alias("n_spans")
    return done.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")

    def listed(s):
        return F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    def number(rank):
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    return scanned.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(listed(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=8)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clustering.clusters(read(spark, sf_dir, "embeddings"), k=16, rounds=3)
    return clustering.with_inertia(assigned, centroids)


QUERIES = {
    "op1_quality": Query(op1_quality, sql.QUALITY),
    "op2_shards": Query(op2_shards),
    "op3_ann": Query(op3_ann),
    "op4_packing": Query(op4_packing),
    "op5_chat": Query(op5_chat, sql.CHAT),
    "op6_mixing": Query(op6_mixing),
    "op7_substrings": Query(op7_substrings, sql.SUBSTRINGS),
    "op8_simhash": Query(op8_simhash),
    "op9_suffixes": Query(op9_suffixes, sql.SUFFIXES),
    "op10_secrets": Query(op10_secrets),
    "op11_lines": Query(op11_lines, sql.LINES),
    "op12_whitening": Query(op12_whitening),
    "op13_clustering": Query(op13_clustering, sql.CLUSTERING),
}
