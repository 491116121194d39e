"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, bpe, changepoints, hnsw, langid, licenses, mixing, quality, secrets, simhash, substrings, tiff, warc
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_round_trip(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.vendor_segments(table(spark, sf_dir, "sale_lines"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hnsw_neighbours, op2_warc_salvage, op3_secret_scans, op4_tiff_media, op5_simhash_near_dedup, op6_language_id, op7_sainte_lague_mixing, op8_substring_dedup, op9_license_scans, op10_byte_level_bpe, op11_change_points, op12_ball_kmeans, op13_quality_rules)}

ORACLE_SQL = {"op2_warc_salvage": warc.SQL, "op8_substring_dedup": substrings.SQL, "op7_sainte_lague_mixing": mixing.SQL, "op9_license_scans": licenses.sql(), "op11_change_points": changepoints.SQL, "op12_ball_kmeans": ball_kmeans.sql(), "op13_quality_rules": quality.sql()}
