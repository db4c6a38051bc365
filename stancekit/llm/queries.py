"""One query per operator over its whole table, and the SQL that DuckDB can run.

Every query calls its operator with production parameters and derives the digest
columns from what the operator returns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.llm import ann, counts, decontam, html_extract, mixing, orc_ids, packing, periodic, quality, sharding, simhash, toxicity, trie
from stancekit.llm import common as C


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = packing.pack(C.table(spark, sf_dir, "documents"), payload="crc32")
    return x.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sharding.assign(C.table(spark, sf_dir, "documents"), ["source", "lang", "size"])
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, C.table(spark, sf_dir, "labels")))


def op4_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = C.table(spark, sf_dir, "embeddings")
    return ann.nearest(x, x.where(F.col("vec_id") % 20 == 0))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, C.table(spark, sf_dir, "labels")))


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, kept as a table; then edits to every document."""
    trees = C.written(counts.build(C.table(spark, sf_dir, "documents")), "count-trees")
    edited = counts.apply_edits(trees.withColumn("edits", counts.derived_edits()))
    return edited.select("doc_id", "n_before", "n_tokens", "n_edits", "chars_encoded",
                         F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(C.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.scratch(spark, "orc-ids")
    orc_ids.write_ids(C.table(spark, sf_dir, "documents"), path)
    # read twice by the plan: the running sums and the totals of the files
    rows = C.written(orc_ids.digests(orc_ids.read_ids(spark, path)), "orc-digests")
    return orc_ids.with_start(rows)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(C.table(spark, sf_dir, "pages"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.spliced(trie.numbered(C.table(spark, sf_dir, "conversations"))))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_periods(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digests(periodic.find_runs(docs))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, patterns, sources = mixing.mix(C.table(spark, sf_dir, "documents"), F.array("source"), mixing.words("text"))
    # one source a pattern here: both tables have a row for each source
    named = patterns.select("pattern", F.get("members", F.lit(0)).alias("name")).join(
        F.broadcast(sources), F.col("name").eqNullSafe(F.col("source")))
    return docs.join(F.broadcast(named), "pattern").select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (
    op1_pack, op2_hilbert, op3_toxicity, op4_graph, op5_quality, op6_counts, op7_decontaminate, op8_simhash, op9_orc_ids, op10_main_text,
    op11_trie, op12_runs, op13_mix)}
ORACLE = {"op7_decontaminate": decontam.ORACLE, "op11_trie": trie.ORACLE, "op13_mix": mixing.ORACLE}
