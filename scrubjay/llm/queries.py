"""The registered queries of the corpus operators, with their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from scrubjay.llm import (bpe, covertree, langid, lexical, licenses, minhash, mixing, periodic, secrets, token_files, topk, toxicity,
                          tries)
from scrubjay.llm.common import fold, table
from scrubjay.session import scratch_path

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_secret_scan", secrets.oracle())
def op1(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("windows")


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


@query("op4_mixing", mixing.ORACLE)
def op4(spark, sf_dir):
    mix = mixing.schedule(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", mixing.taken(mix).alias("taken"))


@query("op5_topk", topk.ORACLE)
def op5(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op7_token_files")
def op7(spark, sf_dir):
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_token_files(spark, token_files.open_token_files(folder))


@query("op8_covertree", covertree.ORACLE)
def op8(spark, sf_dir):
    return covertree.link(table(spark, sf_dir, "embeddings"))


@query("op9_minhash", minhash.ORACLE)
def op9(spark, sf_dir):
    return minhash.link(table(spark, sf_dir, "documents"))


@query("op10_bpe")
def op10(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                             ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op11_lexical_search", lexical.ORACLE)
def op11(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_periodic_runs", periodic.ORACLE)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periodic.repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.detect(docs, ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


@query("op13_exact_dedup", tries.ORACLE)
def op13(spark, sf_dir):
    return tries.dedup(table(spark, sf_dir, "documents"))
