"""Queries of the text and algorithm problems, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.runtime import spill_table

from . import nearcopies, packing, pairs, pieces, quantiles, residue, sentences, tokens

PERCENTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
CHUNK_LIMIT, CHUNK_OVERLAP = 1000, 100
CAPACITY = 2048


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(_table(spark, folder, "documents_json"), "seq_num", "content")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    # texts within the limit are whole pieces already; only the rest needs the splitter
    docs = _table(spark, folder, "documents_json").where(F.length("content") > CHUNK_LIMIT)
    cut = pieces.split_oversized(docs, "seq_num", "content", limit=CHUNK_LIMIT, overlap=CHUNK_OVERLAP)
    forced = F.exists("pieces", lambda p: p["forced"])
    return cut.select("seq_num", F.when(forced, "forced").otherwise("natural").alias("cut"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_texts(_table(spark, folder, "documents_json"), "seq_num", "content", limit=CHUNK_LIMIT, overlap=CHUNK_OVERLAP)


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of every day of loading (``scope`` 'day', a null day being one of them) and of all days ('all'), per ocean.

    The days' sketches are built once; the whole is their sum, no reading is read again.
    """
    readings = _table(spark, folder, "observations").select("oceans", F.to_date("loaded_at").alias("loaded_on"), "measurement")
    days = spill_table(quantiles.merge_sketches(quantiles.build_sketches(readings, ["oceans", "loaded_on"], "measurement"), ["oceans", "loaded_on"]), "days")
    whole = quantiles.merge_sketches(days.select("oceans", "n", "sketch"), ["oceans"])
    total = quantiles.sketch_quantiles(whole, ["oceans"], PERCENTILES).select(F.lit("all").alias("scope"), "oceans", F.lit(None).cast("date").alias("loaded_on"), "n", "q", "value")
    return quantiles.sketch_quantiles(days, ["oceans", "loaded_on"], PERCENTILES).withColumn("scope", F.lit("day")).unionByName(total)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, folder, "selfcheck_state"), _table(spark, folder, "documents")).select("state_id", F.col("query_pos").cast("int").alias("query_pos"), "defect")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = nearcopies.near_copies(_table(spark, folder, "documents_json"), "seq_num", "title", "content", threshold=0.6)
    return nearcopies.group_pairs(groups, "seq_num", "group_id", "seq_a", "seq_b")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_ids(_table(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), capacity=CAPACITY)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(_table(spark, folder, "documents"))


_QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p5_percentiles": p5_percentiles,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
}

_ORACLES = {
    "p2_found": r"""
SELECT seq_num, CASE WHEN list_max([length(s) FOR s IN regexp_split_to_array(content, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？।]')]) > 1000
       THEN 'forced' ELSE 'natural' END AS cut
FROM documents_json WHERE length(content) > 1000
""",
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
