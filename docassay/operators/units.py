"""Quantities recorded in different units, brought to one unit each, as one SQL plan.

Every step is SQL: a regular expression takes number and unit out of the text, an alias join
normalises the unit, the unit of the cell outranks the unit around it (header, unit row, title),
which outranks a source default, and factor and offset give the common unit.

Defined results: null, empty, neutral ('-', 'TBD') and unreadable texts give no value; a unit that is
missing or does not fit the quantity gives a row with a null value; a redelivered cell counts once; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import cut

# Dimension, value of one unit in the base unit of its dimension, offset added after
# scaling, and the spellings of the unit (lower case, superscripts and micro signs as ASCII).
UNITS = [
    ("pressure", 1.0, 0.0, ["pa"]),
    ("pressure", 1e3, 0.0, ["kpa", "kilopascal", "kilopascals"]),
    ("pressure", 1e6, 0.0, ["mpa", "n/mm2", "megapascal"]),
    ("pressure", 1e5, 0.0, ["bar", "bars"]),
    ("pressure", 1e2, 0.0, ["mbar"]),
    ("pressure", 6894.757293168361, 0.0, ["psi", "lbf/in2", "lb/in2"]),
    ("pressure", 6894757.293168361, 0.0, ["ksi"]),
    ("pressure", 101325.0, 0.0, ["atm"]),
    ("pressure", 98066.5, 0.0, ["kg/cm2", "kgf/cm2"]),
    ("temperature", 1.0, 0.0, ["k", "kelvin"]),
    ("temperature", 1.0, 273.15, ["°c", "degc", "deg c", "c", "celsius"]),
    ("temperature", 5 / 9, 459.67 * 5 / 9, ["°f", "degf", "deg f", "f", "fahrenheit"]),
    ("length", 1.0, 0.0, ["m", "metre", "metres", "meter", "meters"]),
    ("length", 1e-2, 0.0, ["cm"]),
    ("length", 1e-3, 0.0, ["mm"]),
    ("length", 1e-6, 0.0, ["um", "micron", "microns"]),
    ("length", 0.0254, 0.0, ["in", "inch", "inches", '"']),
    ("length", 0.0000254, 0.0, ["mil", "mils", "thou"]),
    ("length", 0.3048, 0.0, ["ft", "foot", "feet"]),
    ("volume", 1.0, 0.0, ["m3", "cu m", "cubic metres"]),
    ("volume", 1e-3, 0.0, ["l", "ltr", "litre", "litres", "liter", "liters"]),
    ("volume", 0.028316846592, 0.0, ["ft3", "cu ft", "cubic feet"]),
    ("volume", 0.003785411784, 0.0, ["us gal", "gal"]),
    ("mass", 1.0, 0.0, ["kg", "kgs", "kilogram", "kilograms"]),
    ("mass", 1e-3, 0.0, ["g", "gram", "grams"]),
    ("mass", 1e3, 0.0, ["t", "mt", "tonne", "tonnes"]),
    ("mass", 0.45359237, 0.0, ["lb", "lbs", "pound", "pounds"]),
    ("flow", 1.0 / 3600, 0.0, ["m3/h", "m3/hr", "cu m per hour"]),
    ("flow", 1e-3, 0.0, ["l/s"]),
    ("flow", 1e-3 / 60, 0.0, ["l/min", "lpm"]),
    ("flow", 0.003785411784 / 60, 0.0, ["us gpm", "gpm"]),
    ("power", 1.0, 0.0, ["w"]),
    ("power", 1e3, 0.0, ["kw"]),
    ("power", 1e6, 0.0, ["mw"]),
    ("power", 745.699872, 0.0, ["hp"]),
    ("ratio", 1.0, 0.0, ["1", "fraction"]),
    ("ratio", 1e-2, 0.0, ["%", "percent", "pct"]),
]


def alias_rows() -> str:
    """The alias table as an inline VALUES list."""
    rows = [
        f"('{dimension}', '{alias}', cast({factor!r} as double), cast({offset!r} as double))"
        for dimension, factor, offset, aliases in UNITS
        for alias in aliases
    ]
    return "(VALUES " + ", ".join(rows) + ") AS u(dimension, alias, factor, shift)"


def _alias(unit: str) -> str:
    """SQL: the alias key of a unit text."""
    return f"lower(regexp_replace(replace(replace(translate({unit}, '²³µμ', '23uu'), '℃', '°C'), '℉', '°F'), '\\\\s+', ' '))"


def _scaled(text: str, part: int) -> str:
    """SQL: part 1 the scale word, part 2 the unit of a unit text such as ``10^3 US gal``."""
    return rf"regexp_extract({text}, '^(?i:(x ?[0-9]+|10\\^[0-9]+|hundred|thousand|million)\\s+)?(\\S.*)$', {part})"


def _scale(word: str) -> str:
    return rf"""case when {word} is null or {word} = '' then 1D
        when lower({word}) = 'hundred' then 100D when lower({word}) = 'thousand' then 1000D when lower({word}) = 'million' then 1000000D
        when {word} like '10^%' then power(10D, try_cast(substr({word}, 4) as double))
        else coalesce(try_cast(trim(substr({word}, 2)) as double), 1D) end"""


MANTISSA = r"[-+−]?[0-9](?:[0-9.,'' ]*[0-9])?"
EXPONENT = r"\\s*[eE][-+]?[0-9]+|\\s*[x×]\\s*10\\^?[-−]?[0-9]+"

VALUES_SQL = """
WITH alias AS (SELECT * FROM {alias_rows}),
target AS (SELECT t.*, u.dimension, u.factor AS to_factor, u.shift AS to_shift FROM {target_rows} JOIN alias u ON u.alias = {alias_of_target}),
plain AS (
  SELECT cell_id, doc_id, table_index, row_index, greatest(coalesce(row_span, 1), 1) AS row_span, col_index,
         trim(translate(text, '\u00a0\u202f\u2009\u2007', '    ')) AS text
  FROM {cells_view} WHERE text IS NOT NULL
),
split AS (
  SELECT *,
    regexp_replace(lower(regexp_extract(text, '^(?i:({quantities}))(?![0-9A-Za-z])', 1)), '\\\\s+', ' ') AS header_q,
    regexp_extract(text, '^(?i:{quantities})[\\\\s,/:(\\\\[-]*(.*?)[\\\\s)\\\\]]*$', 1) AS header_unit
  FROM plain
),
-- what stands around the values of a table: headers and unit rows by column, units of quantities in titles
around AS (
  SELECT doc_id, table_index,
    array_distinct(flatten(collect_list(CASE WHEN header_q = '' AND text LIKE '%;% in %' THEN
      transform(filter(split(text, ';'), p -> p RLIKE '^\\\\s*.+?\\\\s+in\\\\s+.+'), p -> struct(
        regexp_replace(lower(regexp_extract(p, '^\\\\s*(.+?)\\\\s+in\\\\s+(.+?)\\\\s*$', 1)), '\\\\s+', ' ') AS key, regexp_extract(p, '^\\\\s*(.+?)\\\\s+in\\\\s+(.+?)\\\\s*$', 2) AS value)) END))) AS titles,
    collect_set(CASE WHEN header_q <> '' AND col_index > 0 THEN struct(col_index, row_index, header_q, header_unit) END) AS heads,
    collect_set(CASE WHEN header_q = '' AND col_index > 0 AND s_alias IS NOT NULL THEN struct(col_index, text) END) AS unit_rows
  FROM (SELECT split.*, u.alias AS s_alias FROM split LEFT JOIN (SELECT DISTINCT alias FROM alias WHERE alias <> '1') u ON u.alias = {alias_of_row})
  WHERE header_q <> '' OR s_alias IS NOT NULL OR text LIKE '%;% in %'
  GROUP BY doc_id, table_index
),
columns AS (
  SELECT h.*, t.quantity, t.dimension, t.to_factor, t.to_shift, t.common_unit FROM (
    SELECT doc_id, table_index, head.col_index, head.header_q,
      coalesce(nullif(head.header_unit, ''), try_element_at(filter(unit_rows, u -> u.col_index = head.col_index), 1).text, try_element_at(filter(titles, p -> p.key = head.header_q), 1).value) AS around_unit
    FROM around LATERAL VIEW explode(filter(heads, h -> NOT exists(heads, o -> o.col_index = h.col_index AND o.row_index < h.row_index))) AS head
    WHERE size(heads) > 0) h
  JOIN target t ON t.q = h.header_q
),
tags AS (
  SELECT doc_id, table_index, row_at, min_by(text, row_index) AS tag
  FROM (SELECT *, explode(sequence(row_index, row_index + row_span - 1)) AS row_at FROM plain WHERE col_index = 0 AND text <> '')
  GROUP BY doc_id, table_index, row_at
),
-- number and unit of a data cell: one rewriting puts the parts in one order (form, number, exponent, unit); generators
-- of one row keep the optimizer from writing it out at every later use
numbers AS (
  SELECT cell_id, doc_id, table_index, row_index, col_index, text, p FROM plain LATERAL VIEW explode(array(split(CASE
      WHEN text RLIKE '{feet}' THEN regexp_replace(text, '{feet}', 'F|$1|$2|$3|$4')
      WHEN text RLIKE '{suffix}' THEN regexp_replace(text, '{suffix}', 'S|$1|$2|$3')
      WHEN text RLIKE '{prefix}' THEN regexp_replace(text, '{prefix}', 'S|$2|$3|$1') END, '[|]', -1))) AS p
  WHERE col_index > 0 AND text RLIKE '[0-9]'
),
chosen AS (
  SELECT cell_id, doc_id, table_index, row_index, col_index, text, p, m, text RLIKE '^[(].*[)]' AS minus, p[1] RLIKE '['' ]' AS grouped,
    CASE WHEN p[0] = 'F' THEN 'ft' ELSE nullif(p[3], '') END AS own_unit
  FROM numbers LATERAL VIEW explode(array(regexp_replace(translate(p[1], '−', '-'), '['' ]', ''))) AS m
  WHERE p IS NOT NULL
),
read AS (
  SELECT cell_id, doc_id, table_index, row_index, col_index, text, own_unit, CASE
      WHEN p[0] = 'F' THEN try_cast(m AS double) + (coalesce(try_cast(nullif(p[2], '') AS double), 0D)
           + coalesce(try_divide(try_cast(nullif(p[3], '') AS double), try_cast(nullif(p[4], '') AS double)), 0D)) / 12D
      ELSE try_cast({plain_number} AS double) * CASE WHEN p[2] = '' THEN 1D ELSE power(10D, coalesce(try_cast(regexp_extract(translate(p[2], '−', '-'), '([-+]?[0-9]+)$', 1) AS int), 0)) END * CASE WHEN minus THEN -1D ELSE 1D END END AS number
  FROM chosen
)
SELECT DISTINCT r.cell_id, r.doc_id, r.table_index, r.row_index, r.col_index, g.tag, a.quantity, r.text, r.number,
       coalesce(r.own_unit, {around}, CASE WHEN a.dimension = 'ratio' THEN '1' END) AS unit,
       CASE WHEN r.own_unit IS NOT NULL THEN 'CELL' WHEN a.around_unit IS NOT NULL THEN 'AROUND' WHEN {around} IS NOT NULL THEN 'SOURCE' WHEN a.dimension = 'ratio' THEN 'RATIO' END AS unit_from,
       ((CASE WHEN r.own_unit IS NULL THEN {scale_around} ELSE 1D END * r.number * f.factor + f.shift) - a.to_shift) / a.to_factor AS value,
       a.common_unit
FROM read r
JOIN columns a ON a.doc_id = r.doc_id AND a.table_index = r.table_index AND a.col_index = r.col_index
{default_join}
LEFT JOIN alias f ON f.dimension = a.dimension AND f.alias = {alias_of_unit}
JOIN tags g ON g.doc_id = r.doc_id AND g.table_index = r.table_index AND g.row_at = r.row_index
WHERE r.number IS NOT NULL
"""

RULES_SQL = """
WITH alias AS (SELECT * FROM {alias_rows}),
target AS (SELECT t.*, u.dimension, u.factor AS to_factor, u.shift AS to_shift FROM {target_rows} JOIN alias u ON u.alias = {alias_of_target}),
stated AS (
  SELECT rule_no, numeric_limit_params.parameter_name AS parameter_name, numeric_limit_params.limit_value AS number,
    regexp_replace(lower(regexp_extract(numeric_limit_params.parameter_name, '(?i:(?:^|\\\\s)({quantities}))\\\\s*$', 1)), '\\\\s+', ' ') AS q,
    coalesce(
      nullif(regexp_extract(title, '[(\\\\[]([^()\\\\[\\\\]]+)[)\\\\]]\\\\s*$', 1), ''),
      nullif(regexp_extract(message_template, '[{{]limit[}}]\\\\s*([^{{}}]*?)\\\\s*(?:\\\\bof\\\\b|\\\\bor\\\\b|[.,;]|$)', 1), ''),
      nullif(regexp_extract(recommendation_template, '[{{]limit[}}]\\\\s*([^{{}}]*?)\\\\s*(?:\\\\bof\\\\b|\\\\bor\\\\b|[.,;]|$)', 1), ''),
      nullif(replace(regexp_extract(numeric_limit_params.pattern, '[)]\\\\\\\\s[*]([^()\\\\[\\\\]]+)$', 1), '\\\\', ''), '')) AS unit
  FROM {rules_view} WHERE kind = 'numeric_limit'
)
SELECT DISTINCT s.rule_no, s.parameter_name, t.quantity, s.number, coalesce(s.unit, CASE WHEN t.dimension = 'ratio' THEN '1' END) AS unit,
       (s.number * f.factor + f.shift - t.to_shift) / t.to_factor AS value, t.common_unit
FROM stated s JOIN target t ON t.q = s.q
JOIN alias f ON f.dimension = t.dimension AND f.alias = {alias_of_unit}
WHERE s.number IS NOT NULL
"""

#: Two values match when they differ by at most this share of the larger.
TOLERANCE = 0.005

PAIRS_SQL = """
WITH banded AS (
  SELECT kind, owner, quantity, key, value, int(signum(value)) AS side,
         CASE WHEN value = 0D THEN 0L ELSE bigint(floor(ln(abs(value)) / {width})) END AS band
  FROM {normalised_view}
),
reach AS (SELECT kind, owner, quantity, key, value, side, band, explode(array(band, band + 1)) AS at FROM banded)
SELECT a.kind, least(a.key, b.key) AS key_a, greatest(a.key, b.key) AS key_b
FROM banded a JOIN reach b
  ON a.kind = b.kind AND a.owner = b.owner AND a.quantity = b.quantity AND a.side = b.side AND a.band = b.at
WHERE (a.band <> b.band OR a.key < b.key)
  AND abs(a.value - b.value) <= {tolerance} * greatest(abs(a.value), abs(b.value)) + 1e-9 * greatest(abs(a.value), abs(b.value))
"""

def _plain_number() -> str:
    """SQL: the mantissa with a decimal point and without group marks.

    With both marks the later one is the decimal mark; a mark that repeats parts thousands; a lone
    comma before exactly three final digits parts thousands unless spaces or apostrophes already do.
    """
    m, grouped = "m", "grouped"
    tail = lambda mark: f"length(substring_index({m}, '{mark}', -1))"
    return f"""CASE
        WHEN {m} LIKE '%,%' AND {m} LIKE '%.%' AND {tail(',')} < {tail('.')} THEN replace(replace({m}, '.', ''), ',', '.')
        WHEN {m} LIKE '%,%' AND {m} LIKE '%.%' THEN replace({m}, ',', '')
        WHEN {m} LIKE '%,%,%' THEN replace({m}, ',', '')
        WHEN {m} RLIKE '^[-+]?[0-9]+,[0-9][0-9][0-9]$' AND NOT ({grouped}) THEN replace({m}, ',', '')
        WHEN {m} LIKE '%,%' THEN replace({m}, ',', '.')
        WHEN {m} LIKE '%.%.%' THEN replace({m}, '.', '')
        ELSE {m} END"""


def _targets(unit_targets: DataFrame) -> dict[str, str]:
    """The quantities (a small fixed table) as an inline relation, and one pattern that finds any of them."""
    rows = sorted({(r.quantity, r.common_unit) for r in unit_targets.where("quantity IS NOT NULL AND common_unit IS NOT NULL").select("quantity", "common_unit").collect()})
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "''") + "'"
    values = ", ".join(f"({quoted(q)}, {quoted(' '.join(q.lower().split()))}, {quoted(u)})" for q, u in rows) or "('', '\\u0000', '')"
    names = sorted({" ".join(q.split()) for q, _ in rows}, key=lambda q: (-len(q), q)) or ["\\u0000"]
    pattern = "|".join("\\\\s+".join(re.escape(w).replace("\\", "\\\\") for w in q.split()) for q in names).replace("'", "''")
    return {"target_rows": f"(VALUES {values}) AS t(quantity, q, common_unit)", "quantities": pattern, "alias_of_target": _alias("t.common_unit"), "alias_rows": alias_rows()}


def _planned(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The plan of a text in which {name_view} stands for a table; the views it takes are gone afterwards."""
    names = {name: f"docassay_{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createTempView(names[name])
        sql = sql.replace(f"@{name}@", names[name])
    try:
        return spark.sql(sql)
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def cell_values(spark: SparkSession, cells: DataFrame, unit_targets: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Each readable table cell of a known quantity with its value in the common unit.

    unit_from tells whose unit counts: CELL, AROUND (header, unit row, title), SOURCE or RATIO. ``defaults``
    (doc_id, quantity, unit) gives the units that a source writes no unit for; a number without any unit, or with
    one that doesn't fit the quantity, has a row with a null value.

    The cells are read three times (values, tags, surroundings) and joined on their table; what stands
    around the values of a table is few cells, however many rows the table has.
    """
    around = "a.around_unit" if defaults is None else "coalesce(a.around_unit, d.unit)"
    feet = r"^([0-9]+)\\s*(?:''|ft|feet)\\s*-?\\s*([0-9]+)?\\s*(?:([0-9]+)/([0-9]+))?\\s*(?:\"|in|inch)$"
    sql = VALUES_SQL.format(
        **_targets(unit_targets), feet=feet,
        suffix=rf"^[(]?({MANTISSA})({EXPONENT})?[)]?\\s*([^0-9\\s.,'')].*)?$",
        prefix=rf"^([^0-9\\s(+−-].*?)\\s+({MANTISSA})({EXPONENT})?$",
        plain_number=_plain_number(),
        alias_of_row=_alias(_scaled("text", 2)),
        scale_around=_scale(_scaled(around, 1)), around=around, cells_view="@cells@",
        default_join="" if defaults is None else "LEFT JOIN @defaults@ d ON d.doc_id = r.doc_id AND d.quantity = a.quantity",
        alias_of_unit=_alias(f"CASE WHEN r.own_unit IS NOT NULL THEN r.own_unit WHEN {around} IS NOT NULL THEN {_scaled(around, 2)} WHEN a.dimension = 'ratio' THEN '1' END"),
    )
    given = {} if defaults is None else {"defaults": defaults.select("doc_id", "quantity", "unit").dropDuplicates(["doc_id", "quantity"])}
    return _planned(spark, sql, cells=cells, **given)


def rule_values(spark: SparkSession, rules: DataFrame, unit_targets: DataFrame) -> DataFrame:
    """Each numeric rule limit with its value in the common unit; the unit is read from the rule's texts."""
    return _planned(spark, RULES_SQL.format(**_targets(unit_targets), rules_view="@rules@", alias_of_unit=_alias("coalesce(s.unit, CASE WHEN t.dimension = 'ratio' THEN '1' END)")), rules=rules)


def equal_quantities(spark: SparkSession, cells: DataFrame, rules: DataFrame, unit_targets: DataFrame) -> DataFrame:
    """Pairs (kind, key_a, key_b) that record one quantity with values within the tolerance.

    A range join: values fall into logarithmic bands a little wider than the tolerance, so equal ones
    lie in one band or in neighbours, and an equi-join on the band meets each pair once. The values are
    written to the shared folder first, as both sides of the join read them.
    """
    by_cell = cell_values(spark, cells, unit_targets).selectExpr("'cell' AS kind", "tag AS owner", "quantity", "cell_id AS key", "value")
    by_rule = rule_values(spark, rules, unit_targets).selectExpr("'rule' AS kind", "parameter_name AS owner", "quantity", "rule_no AS key", "value")
    values = cut(by_cell.unionByName(by_rule).where("value IS NOT NULL AND NOT isnan(value)"))
    return _planned(spark, PAIRS_SQL.format(width=1.1 * TOLERANCE, tolerance=TOLERANCE, normalised_view="@normalised@"), normalised=values)
