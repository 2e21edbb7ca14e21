"""Numbers written in text: exact decimals with units, roman numerals, page labels, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of cells that say nothing, and unit spellings with their common form.
NEUTRAL = ["", "-", "--", "---", "–", "—", "n/a", "na", "null", "none", "tbd", "nil"]
UNIT_FORMS = {"lbs": "lb", "lb": "lb", "ft-lbs": "ft-lb", "ft-lb": "ft-lb", "hrs": "hr", "hr": "hr", "h": "hr", "sec": "s", "s": "s", "mins": "min", "min": "min", "pcs": "pcs", "items": "items", "ea": "ea", "nos": "nos", "qty": "qty", "usd": "$", "$": "$", "eur": "€", "€": "€", "gbp": "£", "£": "£"}
CURRENCY = r"^([$€£¥]|(?i:Rp\.?|IDR|USD|EUR))\s*"
UNIT = r"\s*((?i:%|°[CF]|(?:K|MPa|kPa|GPa|psi|ksi|bar|mbar|kN|N|lbf|kgf|mm|cm|m|in|ft|kg|g|mg|t|tonne|ton|lbs?|oz|kJ|J|ft-lbs?|sec|s|min|hrs?|h|pcs|ea|qty|nos|items?)))$"
HEADER_UNIT = r"(?:[(\[]\s*([A-Za-z%°][A-Za-z0-9%°/.$€£-]*)\s*[)\]]|,\s*([A-Za-z%°][A-Za-z0-9%°/.$€£-]*)$)"
#: Exact type of parsed values.
DECIMAL = "decimal(28,10)"
#: Locales in which a lone comma before three digits is a decimal mark.
COMMA_LOCALES = ("de", "eu", "id")


def _form(unit: Column) -> Column:
    forms = F.create_map(*[F.lit(x) for kv in UNIT_FORMS.items() for x in kv])
    return F.when(F.trim(unit) == "", None).otherwise(F.coalesce(forms[F.lower(F.trim(unit))], F.trim(unit)))


def _plain(text: Column) -> Column:
    """Compatibility digits, signs and spaces in their ordinary form."""
    return F.trim(F.translate(text, "０１２３４５６７８９．，－＋％（）\u00a0\u3000\u202f\u2009\u2007", "0123456789.,-+%()     "))


def header_unit(text: Column) -> Column:
    """The unit a header names in brackets or behind a comma."""
    return _form(F.concat(F.regexp_extract(text, HEADER_UNIT, 1), F.regexp_extract(text, HEADER_UNIT, 2)))


def neutral(text: Column) -> Column:
    return F.lower(_plain(text)).isin(NEUTRAL)


def with_decimal(df: DataFrame, text: str, locale: str = "auto") -> DataFrame:
    """Adds value (exact decimal, null for neutral and non-numeric texts) and unit of a text column.

    Brackets or a minus make it negative; a currency before the number outranks a unit behind it; with
    both separators the later one is the decimal mark, a repeated one parts thousands, and a lone comma
    before exactly three digits parts thousands unless the locale says otherwise. Each step is kept
    apart by a generator of one row, else the optimizer writes it out at every later use.
    """
    step = lambda d, column, name: d.select("*", F.explode(F.array(column)).alias(name))
    out = step(df, _plain(F.col(text)), "_t")
    bracketed = F.col("_t").rlike(r"^\(.*\)$")
    out = out.withColumn("_neg", bracketed | F.col("_t").startswith("-"))
    out = step(out, F.trim(F.when(bracketed, F.regexp_replace("_t", r"^\(|\)$", "")).otherwise(F.regexp_replace("_t", r"^[-+]", ""))), "_t1")
    out = out.withColumn("_cur", F.regexp_extract("_t1", CURRENCY, 1))
    out = step(out, F.trim(F.regexp_replace("_t1", CURRENCY, "")), "_t2")
    out = out.withColumn("_suf", F.regexp_extract("_t2", UNIT, 1))
    out = step(out, F.regexp_replace(F.trim(F.regexp_replace("_t2", UNIT, "")), r"(?<=[0-9])\s+(?=[0-9])", ""), "_d")
    lone = "false" if locale in COMMA_LOCALES else "_d RLIKE ',[0-9][0-9][0-9]$'"
    plain = f"""CASE WHEN NOT _d RLIKE '^[0-9][0-9,.]*$' THEN NULL
        WHEN _d LIKE '%,%' AND _d LIKE '%.%' THEN CASE WHEN length(substring_index(_d, ',', -1)) > length(substring_index(_d, '.', -1)) THEN replace(_d, ',', '') ELSE replace(replace(_d, '.', ''), ',', '.') END
        WHEN _d LIKE '%,%,%' THEN replace(_d, ',', '') WHEN _d LIKE '%,%' THEN CASE WHEN {lone} THEN replace(_d, ',', '') ELSE replace(_d, ',', '.') END
        WHEN _d LIKE '%.%.%' THEN replace(_d, '.', '') ELSE _d END"""
    out = step(out, F.expr(f"try_cast({plain} AS {DECIMAL})"), "_v")
    value = F.when(F.col("_neg"), -F.col("_v")).otherwise(F.col("_v")).cast(DECIMAL)
    unit = F.when(F.col("_v").isNotNull(), F.coalesce(_form(F.col("_cur")), _form(F.col("_suf"))))
    return out.withColumn("value", value).withColumn("unit", unit).drop("_t", "_neg", "_t1", "_cur", "_t2", "_suf", "_d", "_v")


# Roman numerals of up to 4999 by their strict form.
ROMAN = r"^(?i)m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"


def roman(text: Column) -> Column:
    """The value of a strict roman numeral, else null: each sign counts, minus twice what stands before a larger one."""
    t = F.lower(F.trim(text))
    count = lambda s: F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))
    total = sum((count(s) * v for s, v in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000))), F.lit(0))
    less = sum((F.when(t.contains(p), 2 * v).otherwise(0) for p, v in (("iv", 1), ("ix", 1), ("xl", 10), ("xc", 10), ("cd", 100), ("cm", 100))), F.lit(0))
    return F.when((t != "") & t.rlike(ROMAN), (total - less).cast("int"))


def page_value(label: Column) -> Column:
    """The value of an arabic or roman page label, else null."""
    return F.coalesce(F.when(F.trim(label).rlike("^[0-9]+$"), F.trim(label).try_cast("int")), roman(label))


_N = r"[-+]?[0-9]+(?:[.,][0-9]+)?"
_U = r"(?:\s*(?:years?|yrs?|yr|months?|mm|bar|%|°[CF]))?"
_V = r"[A-Za-z][\w-]*"
# The ways an interval is written: pattern, and in one order low, high, and what makes each inclusive.
INTERVALS = [
    (rf"^({_N})\s*(<=|<)\s*{_V}\s*(<=|<)\s*({_N}){_U}$", "$1|$4|$2|$3"),
    (rf"^{_V}\s*(<=|<)\s*({_N}){_U}$", "|$2|=|$1"),
    (rf"^{_V}\s*(>=|>)\s*({_N}){_U}$", "$2||$1|="),
    (rf"^({_N})\s*(<=|<)\s*{_V}{_U}$", "$1||$2|="),
    (rf"^({_N})\s*(?:to|-|–)\s*({_N}){_U}$", "$1|$2|=|="),
    (rf"^between\s+({_N})\s+and\s+({_N}){_U}$", "$1|$2|=|="),
    (rf"^(?:greater|more) than( or equal to)?\s+({_N}){_U}$", "$2||$1|="),
    (rf"^less than( or equal to)?\s+({_N}){_U}$", "|$2|=|$1"),
]


def with_interval(df: DataFrame, text: str, out: str = "band") -> DataFrame:
    """Adds struct(low, high, low_inc, high_inc) of a written interval, else null; ``5 < X`` is a lower bound."""
    step = lambda d, column, name: d.select("*", F.explode(F.array(column)).alias(name))
    signs = F.regexp_replace(F.regexp_replace(F.trim(text), "≤", "<="), "≥", ">=")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(signs, r"[.:]+$", ""), r"\s+", " "), r"(?i)\s*\((?:to\s+)?[0-9]{4}\)\s*$", "")
    staged = step(df, F.trim(F.regexp_replace(t, r"\b([A-Za-z][\w-]*) ([0-9]{4})\b", "$1$2")), "_t")
    line = F.lit(None).cast("string")
    for pattern, parts in reversed(INTERVALS):
        line = F.when(F.col("_t").rlike("(?i)" + pattern), F.regexp_replace("_t", "(?i)" + pattern, parts)).otherwise(line)
    staged = step(staged, F.split(line, r"\|", -1), "_p")
    number = lambda i: F.replace(F.col("_p")[i], F.lit(","), F.lit(".")).try_cast("double")
    band = F.struct(number(0).alias("low"), number(1).alias("high"), F.col("_p")[2].rlike("=|equal").alias("low_inc"), F.col("_p")[3].rlike("=|equal").alias("high_inc"))
    return step(staged, F.when(F.col("_p").isNotNull(), band), out).drop("_t", "_p")


def close(a: Column, b: Column) -> Column:
    """Equal bounds: both missing, or within a hundredth."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.01), F.greatest(F.abs(a), F.abs(b)) * 1e-9), F.lit(False))


def same_interval(a: Column, b: Column) -> Column:
    return close(a["low"], b["low"]) & close(a["high"], b["high"]) & (a["low_inc"] == b["low_inc"]) & (a["high_inc"] == b["high_inc"])
