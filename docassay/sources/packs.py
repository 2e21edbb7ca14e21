"""Rule packs from JSON folders: manifest, rules and benchmark cases, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "pack_id string, name string, standard_code string, edition string, status string, active boolean"
RULES = """rule_id string, standard string, edition string, clause string, standard_page int, severity string, kind string, title string,
  numeric_limit_params struct<parameter_name:string,pattern:string,operator:string,limit_value:double,tolerance:double,context_pattern:string>,
  terminology_params struct<term:string,preferred_term:string,deprecated_terms:array<string>,context_keywords:array<string>>,
  required_reference_params struct<trigger_keywords:array<string>,required_standard:string,required_clause:string,exemption_keywords:array<string>>,
  message_template string, recommendation_template string, requires_engineering_judgement boolean"""
CASES = "case_id string, name string, description string, document_text string, expected_triggers array<string>, is_negative_control boolean"


def _json(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/*/{name}.json")
    return read.withColumn("pack_dir", F.element_at(F.split(F.input_file_name(), "/"), -2))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The packs of a folder (one sub-folder each), by pack_id; a pack without rules is not configured."""
    packs = _json(spark, folder, "manifest", MANIFEST)
    counts = _json(spark, folder, "rules", RULES).groupBy("pack_dir").agg(F.count("*").alias("rules"))
    return packs.join(counts, "pack_dir", "left").withColumn("rules", F.coalesce("rules", F.lit(0))).withColumn("configured", F.col("rules") > 0)


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of all packs of a folder with a stable number."""
    return _json(spark, folder, "rules", RULES).withColumn("rule_no", F.abs(F.xxhash64("pack_dir", "rule_id"))).join(F.broadcast(_json(spark, folder, "manifest", MANIFEST).select("pack_dir", "pack_id")), "pack_dir")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return _json(spark, folder, "benchmarks", CASES).withColumn("case_no", F.abs(F.xxhash64("pack_dir", "case_id"))).join(F.broadcast(_json(spark, folder, "manifest", MANIFEST).select("pack_dir", "pack_id")), "pack_dir")


def resolved(packs: DataFrame, cited: DataFrame, explicit: list[str]) -> DataFrame:
    """Packs named explicitly or whose standard is cited, without inactive ones; an unknown name is an error."""
    unknown = set(explicit) - {r.pack_id for r in packs.where(F.col("pack_id").isin(explicit or [""])).select("pack_id").collect()}
    if unknown:
        raise ValueError(f"unknown packs: {', '.join(sorted(unknown))}")
    key = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    named = packs.where(F.col("pack_id").isin(explicit or [""]))
    met = packs.withColumn("k", key(F.col("standard_code"))).join(cited.select(key(F.col("code")).alias("k")).distinct(), "k", "left_semi").drop("k")
    return named.unionByName(met).dropDuplicates(["pack_id"]).where("coalesce(active, true)")
