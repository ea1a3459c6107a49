"""Queries of the corpus operators over the whole test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterflow.llm import language_id, license_scan, line_dedup, lm_score, media, near_dup, packing, piece_bpe, token_files, topk
from rasterflow.llm.common import materialize
from rasterflow.session import read_table


def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = line_dedup.line_dedup(docs, count_col="n_dropped")
    return cut.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op3_token_files(spark, sf_dir):
    return token_files.read_token_files(token_files.write_token_files(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_piece_bpe(spark, sf_dir):
    return piece_bpe.encode_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lm_score(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.lm_scores(docs, language_id.remainder(by=7) != 2)


def op6_minhash(spark, sf_dir):
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.remainder() == 1)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chroma_fingerprints(spark, sf_dir):
    """A row for each recording: its fingerprint's size and md5; of a query, also its alignments and the best of them."""
    audio = media.recordings(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    prints = materialize(media.fingerprints(audio, "id", "audio"), "fingerprints")
    found = media.align(prints, F.col("id") % 50 == 0)
    best = F.max(F.struct(-F.col("bit_error"), "votes", -F.col("match_id"), "offset"))
    found = found.groupBy(F.col("query_id").alias("q")).agg(F.sort_array(F.collect_set(F.struct("match_id", "n_rows", "offset", "votes", "bit_error"))).alias("alignments"), best.alias("b"))
    found = found.select("q", F.size("alignments").cast("long").alias("n_matches"), (-F.col("b.col3")).alias("best_match"), F.col("b.offset").alias("offset"), F.col("b.votes").alias("votes"), (-F.col("b.col1")).alias("bit_error"), "alignments")
    rows = prints.select("id", F.size("codes").alias("n_codes"), F.md5(F.array_join("codes", ",")).alias("codes_md5"))
    return rows.join(found, rows["id"] == found["q"], "left").drop("q").withColumnRenamed("id", "vec_id")


def op10_top_k(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_files": op3_token_files,
    "op4_piece_bpe": op4_piece_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_minhash": op6_minhash,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_chroma_fingerprints": op9_chroma_fingerprints,
    "op10_top_k": op10_top_k,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op2_line_dedup": line_dedup.oracle_sql("SELECT doc_id, n_dropped::BIGINT AS n_dropped, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM cut"),
    "op10_top_k": topk.ORACLE_SQL,
}
