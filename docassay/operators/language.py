"""Findings in the language of texts: mechanical errors, vague wording, spelling.

A rule is a pattern; all its matches in a text are found at once, with their offsets computed from the
lengths of what lies between them, so matching stays in the JVM.

Defined results: null and blank texts give nothing; texts of fewer than four characters are not judged;
equal findings at one place count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import with_heading

# Grammar rules (id, type, pattern, suggestion or null for the repeated part).
GRAMMAR = [
    ("RULE_GRAMMAR_COMPRISING_BY", "repeated_phrase", r"\bcomprising\s+by\b", "comprising"),
    ("RULE_GRAMMAR_REPEATED_PHRASE", "repeated_phrase", r"\b([A-Za-z]{2,}(?:\s+[A-Za-z]{2,}){1,2})\s+\1\b", "$1"),
    ("RULE_GRAMMAR_SPLIT_YEAR", "spelling_split", r"\b(20[0-9])\s+([0-9])\b", "$1$2"),
    ("RULE_GRAMMAR_SPLIT_WORD", "spelling_split", r"\bnine-teen\b", "nineteen"),
    ("RULE_GRAMMAR_REPEATED_WORD", "repeated_phrase", r"\b([A-Za-z]{2,})\s+\1\b", "$1"),
    ("RULE_GRAMMAR_HOMOPHONE", "grammar_error", r"\b(its)(\s+(?:is|was|are|were|has|have|cannot|should|must|will))\b", "it's$2"),
    ("RULE_GRAMMAR_HOMOPHONE", "grammar_error", r"\b(it's)(\s+(?:thickness|value|diameter|length|weight|pressure|temperature|surface|tolerance|grade))\b", "its$2"),
    ("RULE_GRAMMAR_HOMOPHONE", "grammar_error", r"\b(their)(\s+(?:is|are|was|were))\b", "there$2"),
    ("RULE_GRAMMAR_HOMOPHONE", "grammar_error", r"\b(the\s+)affect(\s+of)\b", "$1effect$2"),
    ("RULE_GRAMMAR_HOMOPHONE", "grammar_error", r"\b(to\s+)loose(\s+(?:pressure|vacuum|compliance|weight|hardness))\b", "$1lose$2"),
    ("RULE_GRAMMAR_AGREEMENT", "grammar_error", r"\b((?:specimens|results|tests|measurements|readings|calculations)\s+)(?:was|is)\b", "$1were"),
    ("RULE_GRAMMAR_AGREEMENT", "grammar_error", r"\b((?:specimen|result|test|measurement|reading|calculation)\s+)(?:were|are)\b", "$1was"),
]
# Fixed value: two numbers that are compared.
PRECISION_PAIR = r"([0-9]+\.[0-9]+)\s*(?:vs\.?|versus|compared\s+(?:with|to))\s*([0-9]+\.[0-9]+)"
# Vague directives and passive wording.
VAGUE = [
    ("VAGUE_SUFFICIENT", "vague_directive", r"\bsufficient(?:ly)?\s+[a-z]+\b", ""),
    ("VAGUE_APPROXIMATELY", "vague_directive", r"\bapproximately(?:\s+[a-z]+)?\b", ""),
    ("VAGUE_AS_APPROPRIATE", "vague_directive", r"\b(?:as\s+appropriate|as\s+applicable|as\s+deemed\s+necessary)\b", ""),
    ("VAGUE_PERIODIC", "vague_directive", r"\bperiodic(?:ally)?\s+(?:inspection|inspected|tested|testing|monitored|monitoring|checked|checking)\b", ""),
    ("VAGUE_CLEAN", "vague_directive", r"\bclean(?:ed)?\s+thoroughly\b", ""),
    ("VAGUE_ADEQUATE", "vague_directive", r"\badequate(?:\s+[a-z]+)?\b", ""),
    ("PASSIVE_AGENT", "passive_voice", r"\b(?:shall\s+be|must\s+be|is|are|was|were|has\s+been|have\s+been)\s+([a-z]+(?:ed|en|t))\s+by\s+(the\s+[a-z\s]+?)(?=[.,;\n]|$)", "$2 $1"),
]
GRADE = r"\b(?:AISI|UNS|ASTM|ASME|SA|A|SS)?[- ]?(?:304L?|316L?|317L?|321H?|410|420|2205|2507|516-(?:60|65|70)|A36)\b"
FAMILIES = {"316": "316_FAMILY", "316l": "316_FAMILY", "304": "304_FAMILY", "304l": "304_FAMILY", "317": "317_FAMILY", "317l": "317_FAMILY", "516-60": "SA516_FAMILY", "516-65": "SA516_FAMILY", "516-70": "SA516_FAMILY"}


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct(start, end, hit)> of all matches of a pattern, positions from 0, case ignored."""
    p = F.lit("(?i)" + pattern)
    hits = F.regexp_extract_all(text, p, 0)
    gaps = F.split(text, "(?i)" + pattern, -1)
    start = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(hits, lambda h, i: F.struct(start(i).alias("start"), (start(i) + F.length(h)).alias("end"), h.alias("hit")))


def _found_by(rule: tuple[str, str, str, str]):
    """What a match of a rule becomes."""
    name, kind, pattern, fix = rule

    def row(m: Column) -> Column:
        suggestion = F.regexp_replace(m["hit"], "(?i)" + pattern, fix) if fix else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("rule_id"), F.lit(kind).alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("original"), suggestion.alias("suggestion"))

    return row


def matches(df: DataFrame, text: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row for each match: all columns and rule_id, type, start, end, original, suggestion.

    A cheap test by one alternation of all rules leaves texts without any finding out first.
    """
    quick = F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for _, _, p, _ in rules if "\\1" not in p))
    repeated = [p for _, _, p, _ in rules if "\\1" in p]
    for p in repeated:
        quick = quick | F.col(text).rlike("(?i)" + p)
    rest = df.where(F.col(text).isNotNull() & (F.length(F.trim(text)) >= 4) & quick)
    found = F.array(*[F.transform(spans_of(F.col(text), rule[2]), _found_by(rule)) for rule in rules])
    return rest.withColumn("m", F.explode(F.flatten(found))).select(*df.columns, "m.*")


def lines(spans: DataFrame, gap: float = 18.0, drop: float = 2.5) -> DataFrame:
    """Spans joined to lines by gaps: (doc_id, page_index, line_no, text, x0, y0, x1, y1) of lines of more than one word."""
    once = spans.dropDuplicates(["item_id"]).where("text IS NOT NULL").select("doc_id", "seq", "item_id", "text", "bbox.*")
    order = Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "seq", "item_id")
    opens = F.lag("y0").over(order).isNull() | (F.abs(F.col("y0") - F.lag("y0").over(order)) > drop) | (F.col("x0") - F.lag("x1").over(order) > gap)
    numbered = once.withColumn("o", opens.cast("int")).withColumn("line_no", F.sum("o").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", "text"))), lambda s: s["text"]))
    grouped = numbered.groupBy("doc_id", "page_index", "line_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))
    return grouped.where("n > 1 AND size(split(trim(text), '\\\\s+')) > 1").drop("n")


def grammar(spans: DataFrame) -> DataFrame:
    """(doc_id, page_index, y0, rule_id, type, original, suggestion) over spans and joined lines, each once a place."""
    once = spans.dropDuplicates(["item_id"]).select("doc_id", F.col("bbox.page_index").alias("page_index"), F.col("bbox.y0").alias("y0"), "text")
    every = once.unionByName(lines(spans).select("doc_id", "page_index", "y0", "text"))
    found = matches(every, "text", GRAMMAR).select("doc_id", "page_index", "y0", "rule_id", "type", "original", "suggestion").unionByName(_precision(every))
    return found.withColumn("band", F.bround("y0")).dropDuplicates(["doc_id", "rule_id", "page_index", "original", "band"]).drop("band")


def _precision(df: DataFrame) -> DataFrame:
    """Pairs of numbers whose places differ by three or more and that disagree at the shorter precision."""
    p = F.lit("(?i)" + PRECISION_PAIR)
    pairs = df.where(F.col("text").rlike("(?i)" + PRECISION_PAIR)).withColumn("m", F.explode(F.arrays_zip(F.regexp_extract_all("text", p, 0).alias("hit"), F.regexp_extract_all("text", p, 1).alias("a"), F.regexp_extract_all("text", p, 2).alias("b"))))
    places = lambda c: F.length(F.substring_index(c, ".", -1))
    few = F.least(places(F.col("m.a")), places(F.col("m.b")))
    rounded = lambda c: F.floor(c.cast("decimal(30,12)") * F.pow(F.lit(10), few).cast("decimal(30,0)") + F.lit("0.5").cast("decimal(2,1)"))
    wrong = (F.abs(places(F.col("m.a")) - places(F.col("m.b"))) >= 3) & (rounded(F.col("m.a")) != rounded(F.col("m.b")))
    return pairs.where(wrong).select("doc_id", "page_index", "y0", F.lit("RULE_SIGFIG_INCONSISTENCY").alias("rule_id"), F.lit("sigfig_inconsistency").alias("type"), F.col("m.hit").alias("original"), F.lit(None).cast("string").alias("suggestion"))


# Key sections, what a sentence can't end with, and recommendations without their subject.
KEY_SECTIONS = r"(?i)\b(?:executive\s+summary|abstract|conclusions?|recommendations?)\b"
GOES_ON = r"(?i)\b(?:and|or|because|which|that|to|of|with|by|for|in)$"
FRAGMENT = r"(?i)^(?:classified|completed|implemented|reinspected|reassessed|reviewed|inspected|replaced|repaired|maintained)\b.*\bby\s+(?:the\s+)?(?:end[- ]?)?20[0-9]{2}\b[.!?]?$"


def unclosed(items: DataFrame, sections: str = KEY_SECTIONS) -> DataFrame:
    """(doc_id, section_item, item_id, text): the last text of a key section, where it has three words or more, no closing
    mark, and ends in a word that goes on or is a recommendation without its subject."""
    placed = with_heading(items.where("trim(text) <> ''")).where("NOT is_heading AND head IS NOT NULL").where(F.col("head.text").rlike(sections))
    last = placed.groupBy("doc_id", F.col("head.item_id").alias("section_item")).agg(F.max_by(F.struct("item_id", "text"), F.struct("page_index", "y0", "seq", "item_id")).alias("l"))
    t = F.trim("text")
    return last.select("doc_id", "section_item", "l.*").where(~t.rlike(r"[.!?:;][\"')\]]?$") & (F.size(F.split(t, r"\s+")) >= 3) & (t.rlike(GOES_ON) | t.rlike(FRAGMENT)))


def ambiguity(spans: DataFrame) -> DataFrame:
    """(doc_id, page_index, rule_id, type, original, suggestion) of vague and passive wording, and of mixed material grades."""
    once = spans.dropDuplicates(["item_id"]).select("item_id", "doc_id", F.col("bbox.page_index").alias("page_index"), "text")
    wording = matches(once, "text", VAGUE).select("doc_id", "page_index", "rule_id", "type", "original", "suggestion")
    graded = once.where(F.col("text").rlike("(?i)" + GRADE)).withColumn("grade", F.explode(F.regexp_extract_all("text", F.lit("(?i)" + GRADE), 0)))
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    variant = F.lower(F.regexp_extract("grade", r"(?i)(304L?|316L?|317L?|516-(?:60|65|70))", 1))
    graded = graded.withColumn("variant", variant).withColumn("family", family[F.col("variant")]).where("family IS NOT NULL")
    mixed = graded.groupBy("doc_id", "family").agg(F.collect_set("variant").alias("variants")).where("size(variants) > 1")
    grades = graded.join(mixed, ["doc_id", "family"]).select("doc_id", "page_index", F.lit("MIXED_GRADE").alias("rule_id"), F.lit("material_grade").alias("type"), F.col("grade").alias("original"), F.array_join(F.array_sort("variants"), ", ").alias("suggestion"))
    return wording.unionByName(grades)


# ---- spelling ---------------------------------------------------------------------------------

#: A word counts as known from so many places and such a share of all words on, whatever the size of the corpus;
#: shorter words are not judged, and words without a suggestion only from UNSUGGESTED letters on.
KNOWN_TIMES, KNOWN_SHARE, SHORTEST, UNSUGGESTED = 5, 7e-6, 3, 4
#: Scripts written without spaces: a run of their letters is no word.
SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
# Frequent misspellings of the field with their correction.
TYPOS = {
    "teh": "the", "recieve": "receive", "recieved": "received", "recieving": "receiving", "temprature": "temperature", "temparature": "temperature",
    "prcedure": "procedure", "procedeure": "procedure", "specifcation": "specification", "specificaton": "specification", "requirment": "requirement",
    "requirments": "requirements", "calbration": "calibration", "calibraton": "calibration", "tensil": "tensile", "yeild": "yield",
    "elongtion": "elongation", "hardnes": "hardness", "diminsion": "dimension", "diminsions": "dimensions", "thicknes": "thickness",
    "wellding": "welding", "electrod": "electrode", "electrods": "electrodes", "seperator": "separator", "tolerence": "tolerance",
    "definate": "definite", "occurrance": "occurrence", "accaptable": "acceptable", "complience": "compliance", "verifcation": "verification",
    "ceritificate": "certificate", "inspecon": "inspection", "audite": "audit", "criterea": "criteria", "appoved": "approved", "disscuss": "discuss",
    "independant": "independent", "maintainance": "maintenance", "matieral": "material", "metallurigal": "metallurgical", "radiogaphy": "radiography",
    "ultrasonc": "ultrasonic", "referance": "reference",
    # further ones of the field
    "acheive": "achieve", "seperate": "separate", "occured": "occurred", "corossion": "corrosion", "preasure": "pressure", "inspecton": "inspection",
    "equipement": "equipment", "vesel": "vessel", "materal": "material",
}
# Terms, acronyms and symbols of the field, never reported.
TERMS = """
    aisi annealed ansi api asme astm austenite austenitic aws bainitic bevel bop brinell bsi butt calibrated calibration car carbide cen charpy cmtr
    conformance cra crevice csa cvn dimensional din dnv ductility duplex ebw eds egw electrode elongation esw extruded fastener fat fcaw ferrite
    ferritic fillet fitting flange flux forged galvanized gmaw grissik groove gtaw hardness hastelloy haz hbw hic hrb hrc hydrostatic hydrotest
    inconel intergranular iso itb itp jis lapi lbw martensite martensitic mdr medco metallurgical metallurgy microalloyed microstructure monel mss mtr
    nace ncr nde ndt nimonic nonconformance normalized nozzle nps oes passivation paw pearlitic pertamina piping pitting pmi pneumatic pqr pren pwht
    quenched radiography reksolindo rockwell rul sat saw scc sch seamless sem shielding smaw sohic specimen specimens spectrometric spectrometry
    spectroscopy ssc stellite superduplex szc tempered tensile tmin tolerance toughness tpi transgranular tubing ultrasonic uns uts vickers
    weldability welded wpq wps yield
""".split()


def spelling(spans: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_index, y0, word, suggestion, confidence) of listed typos and unknown words.

    A listed typo is reported however often it occurs, unless terms hold it. The corpus itself is the
    vocabulary, with TERMS: words of KNOWN_TIMES places and a share of KNOWN_SHARE. A suggestion is a listed
    typo's correction, or the known word that equals the unknown one after one deletion in either; deletions
    are the join key, so no word is compared with the whole vocabulary. Without one the suggestion is null.
    """
    once = spans.dropDuplicates(["item_id"]).where("text IS NOT NULL").select("doc_id", F.col("bbox.page_index").alias("page_index"), F.col("bbox.y0").alias("y0"), F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_/-])(\p{L}+)(?![\p{L}\p{N}_/-])"), 1)).alias("word"))
    once = once.where(f"length(word) >= {SHORTEST} AND NOT word RLIKE '^[A-Z]{{2,8}}$'").withColumn("low", F.lower("word"))
    counts = once.groupBy("low").agg(F.count("*").alias("times"))
    typo = F.create_map(*[F.lit(x) for kv in TYPOS.items() for x in kv])[F.col("low")]
    total = counts.agg(F.sum("times")).scalar()
    common = (F.col("times") >= KNOWN_TIMES) & (F.col("times") >= total * KNOWN_SHARE)
    known = counts.where((common & typo.isNull()) | F.col("low").isin(TERMS)).select("low")
    listed = counts.where(typo.isNotNull()).select("low")
    if terms is not None:
        own = terms.select(F.lower("term").alias("low")).distinct()
        known, listed = known.unionByName(own).distinct(), listed.join(own, "low", "left_anti")
    unknown = counts.select("low").join(known, "low", "left_anti").where(typo.isNull())
    shorter = F.expr("array_distinct(concat(array(low), transform(sequence(1, length(low)), i -> concat(substr(low, 1, i - 1), substr(low, i + 1)))))")
    # words of up to this length have neighbours looked up; longer strings are codes, not words
    neighbours = unknown.where("length(low) <= 40").withColumn("k", F.explode(shorter)).alias("u").join(known.where("length(low) BETWEEN 3 AND 41").withColumn("k", F.explode(shorter)).alias("v"), "k").where("abs(length(u.low) - length(v.low)) <= 1").groupBy(F.col("u.low").alias("low")).agg(F.min("v.low").alias("suggestion"))
    judged = unknown.join(neighbours, "low", "left").where(F.col("suggestion").isNotNull() | ((F.length("low") >= UNSUGGESTED) & ~F.col("low").rlike(SPACELESS)))
    found = judged.unionByName(listed.withColumn("suggestion", typo)).withColumn("confidence", F.when(F.col("suggestion").isNotNull(), 0.95).otherwise(0.80))
    return once.join(found, "low").withColumn("band", F.bround("y0")).dropDuplicates(["doc_id", "page_index", "low", "band"]).select("doc_id", "page_index", "y0", "word", "suggestion", "confidence")
