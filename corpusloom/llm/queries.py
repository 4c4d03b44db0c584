"""Queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, html_extract, lattice_lm, merkle, pii, quality, quality_trees, secrets, simhash, substring_dedup, toxicity
from .common import read


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, where the package with these files is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(read(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.query(read(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(read(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.query(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.query(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_pii, op3_html_extract, op4_decontaminate, op5_toxicity, op6_bpe, op7_quality_rules, op8_substring_dedup, op9_simhash, op10_lattice_lm, op11_quality_trees, op12_merkle, op13_collocations)}
ORACLES = {"op7_quality_rules": quality.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE, "op12_merkle": merkle.ORACLE, "op13_collocations": collocations.ORACLE}
