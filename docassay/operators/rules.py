"""Declarative rule packs over texts: rules in, findings out.

Rules are a small fixed dimension. A rule meets only the texts that hold one of its anchor phrases:
the anchors present in a text are extracted with one alternation, exploded and joined to the rules by
equality, so no text is crossed with all rules. Patterns that Java's engine could run away on are
rejected when a pack is loaded.

Defined results: null texts give nothing; a rule without parameters of its kind never fires; equal
findings on a page count once; a rule that needs engineering judgement reports UNRESOLVED.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules a run accepts at most.
MAX_RULES = 500

_UNSAFE = re.compile(r"\([^()]*[+*][^()]*\)[+*{]|\([^()]*\|[^()]*\)[+*]\s*[+*]|\\[1-9]")


def unsafe_pattern(pattern: str | None) -> bool:
    """True for patterns with nested quantifiers or back-references, which may take exponential time."""
    if not pattern:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return True
    return bool(_UNSAFE.search(pattern))


def loaded(rules: DataFrame) -> DataFrame:
    """A pack after validation: one row of each rule, parameters that match its kind, patterns that are safe."""
    if rules.count() > MAX_RULES:
        raise ValueError(f"a run accepts {MAX_RULES} rules at most")
    safe = F.pandas_udf(lambda p: p.map(lambda x: not unsafe_pattern(x)).astype(bool), "boolean")
    match = F.expr(
        "CASE kind WHEN 'numeric_limit' THEN numeric_limit_params IS NOT NULL WHEN 'terminology' THEN terminology_params IS NOT NULL WHEN 'required_reference' THEN required_reference_params IS NOT NULL ELSE false END"
    )
    return rules.dropDuplicates(["rule_no"]).where(match).where(safe(F.col("numeric_limit_params.pattern")))


def _word(phrase: Column) -> Column:
    """Regular expression of a phrase as whole words."""
    return F.concat(F.lit(r"(?i)(?<!\w)"), F.regexp_replace(phrase, r"([\\.^$|?*+()\[\]{}])", r"\\$1"), F.lit(r"(?!\w)"))


def _anchored(texts: DataFrame, anchors: list[str]) -> DataFrame:
    """(…, anchor): each text with each anchor phrase it holds, in lower case."""
    if not anchors:
        return texts.withColumn("anchor", F.lit(None).cast("string")).where("false")
    ordered = sorted({a.lower() for a in anchors}, key=lambda a: (-len(a), a))
    # a look-ahead finds phrases that overlap or begin inside others
    alternation = "(?<![\\p{L}\\p{N}])(?=(" + "|".join(r"\s+".join(re.escape(w) for w in a.split()) for a in ordered) + ")(?![\\p{L}\\p{N}]))"
    hits = F.regexp_extract_all(F.lower("text"), F.lit(alternation), 1)
    longest = texts.withColumn("hit", F.explode(F.array_distinct(hits)))
    # a longer phrase may hide a shorter one with the same beginning
    heads = {a: [b for b in ordered if b != a and re.match(re.escape(b) + r"\b", a)] for a in ordered}
    more = F.create_map(*[x for a, bs in heads.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in [a, *bs]]))])
    return longest.withColumn("anchor", F.explode(more[F.regexp_replace("hit", r"\s+", " ")])).drop("hit")


def limit_findings(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text_key, page, rule_no, rule_id, value, limit_value, status) where a stated value breaks a limit."""
    limits = rules.where("kind = 'numeric_limit'").select("rule_no", "rule_id", "requires_engineering_judgement", "numeric_limit_params.*").withColumn("anchor", F.regexp_replace(F.lower("parameter_name"), r"\s+", " "))
    names = [r.anchor for r in limits.select("anchor").distinct().collect() if r.anchor]
    met = _anchored(texts, names).join(F.broadcast(limits), "anchor").where("context_pattern IS NULL OR text RLIKE concat('(?i)', context_pattern)")
    value = F.explode(F.expr("regexp_extract_all(text, concat('(?i)', pattern), 1)"))
    found = met.select("text_key", "page", "rule_no", "rule_id", "operator", "limit_value", "tolerance", "requires_engineering_judgement", value.alias("raw"))
    found = found.withColumn("value", F.expr("try_cast(replace(raw, ',', '') AS double)")).where("value IS NOT NULL")
    broken = F.expr(
        "CASE operator WHEN 'GE' THEN value < limit_value - coalesce(tolerance, 0) WHEN 'LE' THEN value > limit_value + coalesce(tolerance, 0) WHEN 'GT' THEN value <= limit_value WHEN 'LT' THEN value >= limit_value"
        " WHEN 'EQ' THEN abs(value - limit_value) > coalesce(tolerance, 0) ELSE false END"
    )
    status = F.when(F.col("requires_engineering_judgement"), "UNRESOLVED").otherwise("NON_COMPLIANT")
    return found.where(broken).select("text_key", "page", "rule_no", "rule_id", "value", "limit_value", status.alias("status")).distinct()


def term_findings(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text_key, page, rule_no, rule_id, term, status) where a deprecated term stands in its context."""
    terms = rules.where("kind = 'terminology'").select("rule_no", "rule_id", "requires_engineering_judgement", "terminology_params.context_keywords", F.explode("terminology_params.deprecated_terms").alias("deprecated"))
    terms = terms.withColumn("anchor", F.regexp_replace(F.lower("deprecated"), r"\s+", " "))
    names = [r.anchor for r in terms.select("anchor").distinct().collect() if r.anchor]
    met = _anchored(texts, names).join(F.broadcast(terms), "anchor").withColumn("as_word", _word(F.col("deprecated")))
    met = met.withColumn("rest", F.regexp_replace("text", F.col("as_word"), F.lit(" "))).withColumn("times", F.size(F.expr("regexp_extract_all(text, as_word, 0)")))
    # a keyword counts outside of the term itself: in the rest of the text, or in another place of the term
    met = met.withColumn("keys", F.transform("context_keywords", _word))
    in_context = F.expr("coalesce(size(keys), 0) <= 0 OR exists(keys, k -> rest RLIKE k OR (times > 1 AND deprecated RLIKE k))")
    status = F.when(F.col("requires_engineering_judgement"), "UNRESOLVED").otherwise("NON_COMPLIANT")
    return met.where("times > 0").where(in_context).select("text_key", "page", "rule_no", "rule_id", F.lower("deprecated").alias("term"), status.alias("status")).distinct()


def reference_findings(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text_key, rule_no, rule_id, status) where a document triggers a citation that it lacks.

    Judged over the whole document: each of its texts gives flags, which are combined per document, so
    no document is assembled in one place.
    """
    needs = rules.where("kind = 'required_reference'").select("rule_no", "rule_id", "requires_engineering_judgement", "required_reference_params.*")
    # what may speak for or against a rule: triggers, exemptions, standard and clause
    parts = needs.select("rule_no", F.explode(F.expr("concat(transform(coalesce(trigger_keywords, array()), x -> struct('T' AS part, x AS phrase)), transform(coalesce(exemption_keywords, array()), x -> struct('E' AS part, x AS phrase)), array(struct('S' AS part, required_standard AS phrase)), CASE WHEN required_clause IS NULL THEN array() ELSE array(struct('C' AS part, required_clause AS phrase)) END)")).alias("p")).select("rule_no", "p.*").where("phrase IS NOT NULL AND phrase <> ''")
    parts = parts.withColumn("anchor", F.regexp_replace(F.lower("phrase"), r"\s+", " "))
    names = [r.anchor for r in parts.select("anchor").distinct().collect()]
    seen = _anchored(texts, names).select("text_key", "anchor").distinct().join(F.broadcast(parts), "anchor")
    by_document = seen.groupBy("text_key", "rule_no").agg(F.bool_or(F.col("part") == "T").alias("t"), F.bool_or(F.col("part") == "E").alias("e"), F.bool_or(F.col("part") == "S").alias("s"), F.bool_or(F.col("part") == "C").alias("c"))
    judged = by_document.join(F.broadcast(needs.select("rule_no", "rule_id", "required_clause", "requires_engineering_judgement")), "rule_no")
    status = F.when(F.col("requires_engineering_judgement"), "UNRESOLVED").otherwise("NON_COMPLIANT")
    return judged.where("t AND NOT e AND NOT (s AND (required_clause IS NULL OR c))").select("text_key", "rule_no", "rule_id", status.alias("status")).distinct()


def all_findings(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text_key, rule_no, rule_id, kind, detail, status) of every kind."""
    limits = limit_findings(texts, rules).select("text_key", "rule_no", "rule_id", F.lit("numeric_limit").alias("kind"), F.col("value").cast("string").alias("detail"), "status")
    terms = term_findings(texts, rules).select("text_key", "rule_no", "rule_id", F.lit("terminology").alias("kind"), F.col("term").alias("detail"), "status")
    refs = reference_findings(texts, rules).select("text_key", "rule_no", "rule_id", F.lit("required_reference").alias("kind"), F.lit(None).cast("string").alias("detail"), "status")
    return limits.unionByName(terms).unionByName(refs)


def confusion(benchmarks: DataFrame, rules: DataFrame) -> DataFrame:
    """(pack_id, cases, tp, fp, fn, tn, precision, recall, fpr) of a pack's rules on its cases.

    Only expected and detected pairs are formed; true negatives are what remains of cases times rules.
    """
    texts = benchmarks.dropDuplicates(["case_no"]).select(F.col("case_no").alias("text_key"), F.lit(1).alias("page"), F.col("document_text").alias("text"), "pack_id")
    in_pack = rules.select("rule_id", F.col("pack_id")).distinct()
    detected = all_findings(texts.drop("pack_id"), rules).select("text_key", "rule_id").distinct().join(texts.select("text_key", "pack_id"), "text_key").join(F.broadcast(in_pack), ["rule_id", "pack_id"])
    expected = benchmarks.dropDuplicates(["case_no"]).select(F.col("case_no").alias("text_key"), "pack_id", F.explode("expected_triggers").alias("rule_id")).distinct().join(F.broadcast(in_pack), ["rule_id", "pack_id"])
    both = detected.withColumn("d", F.lit(1)).join(expected.withColumn("x", F.lit(1)), ["text_key", "pack_id", "rule_id"], "full")
    counts = both.groupBy("pack_id").agg(F.count_if(F.expr("d = 1 AND x = 1")).alias("tp"), F.count_if(F.expr("d = 1 AND x IS NULL")).alias("fp"), F.count_if(F.expr("d IS NULL")).alias("fn"))
    sizes = texts.groupBy("pack_id").agg(F.count("*").alias("cases")).join(in_pack.groupBy("pack_id").agg(F.count("*").alias("rules")), "pack_id")
    out = sizes.join(counts, "pack_id", "left").na.fill(0)
    return out.select(
        "pack_id", "cases", "tp", "fp", "fn", (F.col("cases") * F.col("rules") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"),
        F.round(F.expr("CASE WHEN tp + fp = 0 THEN 1D ELSE tp / (tp + fp) END"), 4).alias("precision"),
        F.round(F.expr("CASE WHEN tp + fn = 0 THEN 1D ELSE tp / (tp + fn) END"), 4).alias("recall"),
        F.round(F.expr("CASE WHEN cases * rules - tp - fn = 0 THEN 0D ELSE fp / (cases * rules - tp - fn) END"), 4).alias("fpr"),
    )


# ---- generic rules over facts -----------------------------------------------------------------

#: Schema of generic rules: parameters are read by name, lists as '|'-separated text.
GENERIC = "rule_id string, rule_type string, parameters map<string,string>"
#: Schema of facts: a text with optional table and prose values and the fields of its sections ('section.field').
FACTS = "fact_id string, text string, page int, table_value string, prose_value string, sections array<string>, fields array<string>"


def judge(spark: SparkSession, rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, rule_id, rule_type, status, detected, confidence): each generic rule on each bundle of facts.

    Only the first match of a pattern is judged. A status for each rule on each fact is the result asked
    for, so there are as many rows; the rules are one bundle of MAX_RULES at most, carried as an array that
    each fact is exploded by.
    """
    bundle = rules.select("rule_id", "rule_type", "parameters").dropDuplicates(["rule_id"]).orderBy("rule_id").collect()
    if len(bundle) > MAX_RULES:
        raise ValueError(f"a run accepts {MAX_RULES} rules at most")
    if not bundle:
        return spark.createDataFrame([], "fact_id string, rule_id string, rule_type string, status string, detected string, confidence double")
    unsafe = {r.rule_id for r in bundle if any(unsafe_pattern(v) for k, v in (r.parameters or {}).items() if "pattern" in k or k in ("trigger_keywords", "required_standard"))}
    array = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.rule_type).alias("rule_type"), F.create_map(*[F.lit(x) for kv in sorted((r.parameters or {"": ""}).items()) for x in kv]).alias("p"), F.lit(r.rule_id in unsafe).alias("unsafe"))
        for r in bundle
    ])
    pairs = facts.select("*", F.explode(array).alias("r")).select("fact_id", "text", "table_value", "prose_value", "sections", "fields", "r.*")
    return spark.sql(JUDGE_SQL, judged_pairs=pairs)


JUDGE_SQL = r"""
WITH m AS (
  SELECT *,
    CASE WHEN rule_type IN ('numeric_range', 'unit_compatibility') THEN p['pattern'] WHEN rule_type = 'citation_edition_match' THEN p['citation_pattern'] WHEN rule_type = 'required_citation' THEN p['trigger_keywords'] WHEN rule_type = 'applicability_condition' THEN p['condition_pattern'] END AS pattern
  FROM {judged_pairs}
),
h AS (
  SELECT *, CASE WHEN pattern IS NULL OR pattern = '' OR unsafe THEN NULL ELSE regexp_substr(text, concat('(?i)', pattern)) END AS hit,
    filter(split(coalesce(p['deprecated_terms'], ''), '\\|'), t -> t <> '' AND text RLIKE concat('(?i)(?<!\\w)\\Q', t, '\\E(?!\\w)')
      AND (coalesce(p['context_keywords'], '') = '' OR exists(split(p['context_keywords'], '\\|'), k -> regexp_replace(text, concat('(?i)(?<!\\w)\\Q', t, '\\E(?!\\w)'), ' ') RLIKE concat('(?i)(?<!\\w)\\Q', k, '\\E(?!\\w)')))) AS outdated
  FROM m
),
g AS (
  SELECT *, CASE WHEN hit IS NULL THEN NULL WHEN pattern LIKE '%(%' AND pattern NOT LIKE '%(?%' THEN regexp_extract(hit, concat('(?i)', pattern), 1) WHEN pattern RLIKE '\\((?!\\?)' THEN regexp_extract(hit, concat('(?i)', pattern), 1) ELSE hit END AS part,
    coalesce(try_cast(p['inclusive_min'] AS boolean), true) AS low_in, coalesce(try_cast(p['inclusive_max'] AS boolean), true) AS high_in
  FROM h
),
v AS (SELECT *, try_cast(replace(part, ',', '') AS double) AS number FROM g)
SELECT fact_id, rule_id, rule_type,
  CASE
    WHEN unsafe THEN 'UNRESOLVED'
    WHEN rule_type = 'required_citation' THEN CASE WHEN hit IS NULL THEN 'NOT_APPLICABLE'
      WHEN coalesce(p['exemption_keywords'], '') <> '' AND exists(split(p['exemption_keywords'], '\\|'), k -> text RLIKE concat('(?i)', k)) THEN 'PASS'
      WHEN coalesce(p['required_standard'], '') <> '' AND text RLIKE concat('(?i)', p['required_standard']) THEN 'PASS' ELSE 'FINDING' END
    WHEN rule_type = 'citation_edition_match' THEN CASE WHEN hit IS NULL THEN 'NOT_APPLICABLE' WHEN trim(part) = p['expected_edition'] THEN 'PASS' ELSE 'FINDING' END
    WHEN rule_type = 'required_section_field' THEN CASE WHEN NOT array_contains(coalesce(sections, array()), p['section_name']) THEN 'NOT_APPLICABLE'
      WHEN array_contains(coalesce(fields, array()), concat(p['section_name'], '.', p['field_name'])) THEN 'PASS' ELSE 'FINDING' END
    WHEN rule_type = 'numeric_range' THEN CASE WHEN hit IS NULL THEN 'NOT_APPLICABLE' WHEN number IS NULL THEN 'UNRESOLVED'
      WHEN number < try_cast(p['min_value'] AS double) OR (NOT low_in AND number = try_cast(p['min_value'] AS double)) THEN 'FINDING'
      WHEN number > try_cast(p['max_value'] AS double) OR (NOT high_in AND number = try_cast(p['max_value'] AS double)) THEN 'FINDING' ELSE 'PASS' END
    WHEN rule_type = 'unit_compatibility' THEN CASE WHEN hit IS NULL THEN 'NOT_APPLICABLE'
      WHEN array_contains(split(lower(coalesce(p['forbidden_units'], '')), '\\|'), lower(trim(part))) THEN 'FINDING'
      WHEN coalesce(p['allowed_units'], '') = '' OR array_contains(split(lower(p['allowed_units']), '\\|'), lower(trim(part))) THEN 'PASS' ELSE 'FINDING' END
    WHEN rule_type = 'terminology_consistency' THEN CASE WHEN size(outdated) > 0 THEN 'FINDING' ELSE 'PASS' END
    WHEN rule_type = 'table_prose_reconciliation' THEN CASE WHEN table_value IS NULL OR prose_value IS NULL THEN 'NOT_APPLICABLE'
      WHEN try_cast(table_value AS double) IS NULL OR try_cast(prose_value AS double) IS NULL THEN 'UNRESOLVED'
      WHEN abs(try_cast(table_value AS double) - try_cast(prose_value AS double)) <= coalesce(try_cast(p['tolerance'] AS double), 0D) THEN 'PASS' ELSE 'FINDING' END
    WHEN rule_type = 'applicability_condition' THEN CASE WHEN hit IS NULL THEN 'NOT_APPLICABLE' ELSE 'UNRESOLVED' END
    ELSE 'UNRESOLVED' END AS status,
  CASE rule_type WHEN 'terminology_consistency' THEN try_element_at(outdated, 1) WHEN 'table_prose_reconciliation' THEN concat_ws(' / ', table_value, prose_value) ELSE part END AS detected,
  CASE WHEN unsafe THEN 0D WHEN rule_type = 'required_citation' AND hit IS NOT NULL AND coalesce(p['exemption_keywords'], '') <> '' AND exists(split(p['exemption_keywords'], '\\|'), k -> text RLIKE concat('(?i)', k)) THEN 0.8D
    WHEN rule_type = 'citation_edition_match' AND hit IS NOT NULL AND NOT (trim(part) <=> p['expected_edition']) THEN 0.9D
    WHEN rule_type = 'applicability_condition' AND hit IS NOT NULL THEN 0.5D WHEN rule_type = 'numeric_range' AND hit IS NOT NULL AND number IS NULL THEN 0D ELSE 1D END AS confidence
FROM v
"""
