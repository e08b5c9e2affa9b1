"""SQL for an independent engine (DuckDB dialect), on the base tables.

Each text starts from the derived grants table and works record by record; nothing of the
library but its word lists and test values is used.
"""

from __future__ import annotations

from checks.fixed import CUSTOM, EXACT, NAME, PRIOR, VERDICT_SQL
from checks.fixtures import grants_sql
from rosterlink.functions import vocabulary as V

ORACLE: dict[str, str] = {}
WS = "'" + V.WHITESPACE + "'"
NM = "recipient_legal_name_en"


def _list(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return f"lower(replace({strip(x)}, '.', ''))"


def pct(part: str, whole: str) -> str:
    return f"round(({part}) * 100.0 / nullif({whole}, 0), 1)"


# Tables that the checks build on, each a CTE on the ones before it.

_names = ", ".join(
    f"{c} AS {c}_raw, {clean(f'''string_split({c}, '|')[1]''')} AS {c}_en, "
    f"{clean(f'''string_split({c}, '|')[2]''')} AS {c}_fr"
    for c in V.NAME_COLUMNS
)
_domestic = f"upper({strip('recipient_country')}) IN {_list(V.DOMESTIC_COUNTRIES)}"
_squeezed = f"upper(translate(recipient_postal_code, {WS}, ''))"
NORMALIZED = f"""
SELECT * EXCLUDE (recipient_business_number, recipient_postal_code, ref_number, _d),
  CASE WHEN {strip('bn_raw')} IN {_list(V.NUMBER_PLACEHOLDERS)}
         OR (length(_d) >= 9 AND substr(_d, 1, 9) IN {_list(V.DIGIT_PLACEHOLDERS)}) THEN NULL
       WHEN length(_d) >= 9 THEN substr(_d, 1, 9) END AS recipient_business_number,
  CASE WHEN {_domestic} THEN CASE WHEN regexp_matches({_squeezed}, '^[A-Z]\\p{{Nd}}[A-Z]\\p{{Nd}}[A-Z]\\p{{Nd}}$') THEN {_squeezed} END
       ELSE recipient_postal_code END AS recipient_postal_code,
  translate(ref_number, {WS}, '') AS ref_number
FROM (SELECT *, {_names}, recipient_business_number AS bn_raw, recipient_postal_code AS postal_code_raw,
        ref_number AS ref_number_raw,
        regexp_replace({strip('recipient_business_number')}, '[^\\p{{Nd}}]', '', 'g') AS _d FROM grants)
"""

_person = f"""(length({NM}) - length(replace({NM}, ',', '')) = 1
  AND length(regexp_extract({NM}, '^[^,]*, ?(.*)$', 1)) <= 18
  AND len(string_split({strip(f"regexp_extract({NM}, '^([^,]*),', 1)")}, ' ')) <= 2
  AND len(string_split({NM}, ' ')) BETWEEN 2 AND 4)"""
_arms = [
    ("research_organization_name_en <> ''", "S"),
    (V.SCHOOL_WORDS, "S"),
    (f"regexp_matches(bn_raw, '{V.CHARITY_NUMBER}')", "N"),
    (V.COMPANY_WORDS, "F"),
    (V.NONPROFIT_WORDS, "N"),
    (V.INDIGENOUS_WORDS, "A"),
    (V.GOVERNMENT_WORDS, "G"),
    (V.HOSPITAL_WORDS, "N"),
    (V.WORSHIP_WORDS, "N"),
    (V.MUSEUM_WORDS, "N"),
    (V.MEDIA_WORDS, "F"),
    (_person, "P"),
]
_case = "CASE " + " ".join(
    "WHEN "
    + (test if number in (0, 2, 11) else f"regexp_matches({NM}, '(?i){test}')")
    + f" THEN '{label}'"
    for number, (test, label) in enumerate(_arms)
) + " END"
CLASSIFIED = f"""
SELECT *, coalesce(recipient_type, rule_label) AS recipient_type_new,
  CASE WHEN recipient_type IS NOT NULL THEN 'original' WHEN rule_label IS NOT NULL THEN 'deterministic' END AS recipient_type_source,
  CASE WHEN coalesce(recipient_type, rule_label) IS NOT NULL THEN 1.0::DOUBLE END AS recipient_type_confidence
FROM (SELECT *, {_case} AS rule_label FROM normalized)
"""

VERDICTS = f"""
SELECT DISTINCT {NM}, {VERDICT_SQL.format(nm=NM)} AS llm_result_json
FROM classified WHERE recipient_type_source IS NULL AND {NM} IS NOT NULL
"""
_fenced = "regexp_extract(llm_result_json, '^\\s*```(?:json)?\\s*((?s:.*?))\\s*```', 1)"
PARSED = f"""
SELECT {NM}, i - 1 AS item_no, j ->> '$.type' AS llm_type, try_cast(j ->> '$.confidence' AS DOUBLE) AS llm_confidence
FROM (SELECT {NM}, unnest(items) AS j, generate_subscripts(items, 1) AS i FROM (
  SELECT {NM}, from_json(CASE WHEN body LIKE '[%' THEN body ELSE '[' || body || ']' END, '["json"]') AS items
  FROM (SELECT {NM}, CASE WHEN {_fenced} <> '' THEN {_fenced} ELSE llm_result_json END AS body FROM verdicts)
  WHERE json_valid(body)))
"""

_linkage = {c: f"CASE WHEN {strip(c)} = '' THEN NULL ELSE {c} END" for c in V.LINKAGE_TEXT_COLUMNS}
_prefix_run = "^(?:(?:" + "|".join(V.COMMON_PREFIXES) + ") )+"
RECORDS = f"""
SELECT *, nullif(regexp_replace({strip(f'lower({NM})')}, '{_prefix_run}', ''), '') AS recipient_legal_name_stripped_en
FROM (SELECT gid AS unique_id, recipient_type_new AS recipient_type,
      {', '.join(f'{x} AS {c}' for c, x in _linkage.items())} FROM classified)
WHERE recipient_type IN {_list(V.RECIPIENT_TYPES)}
  AND recipient_type IN (SELECT recipient_type_new FROM classified GROUP BY 1 HAVING count(*) > 1)
"""
COMPARED = [
    "recipient_legal_name_en",
    "recipient_legal_name_stripped_en",
    "recipient_legal_name_fr",
    "recipient_operating_name_en",
    "recipient_business_number",
    "recipient_postal_code",
    "recipient_city",
    "research_organization_name_en",
]
PROFILES = f"""
SELECT recipient_type, {', '.join(COMPARED)}, min(unique_id) AS id, count(*) AS n
FROM records GROUP BY ALL
"""
RULES = [
    "l.recipient_business_number = r.recipient_business_number",
    f"l.{NM} = r.{NM} AND l.recipient_postal_code = r.recipient_postal_code",
    f"l.{NM} = r.{NM} AND l.recipient_city = r.recipient_city",
    f"l.recipient_postal_code = r.recipient_postal_code AND substr(l.{NM}, 1, 6) = substr(r.{NM}, 1, 6)",
    f"l.recipient_city = r.recipient_city AND substr(l.{NM}, 1, 5) = substr(r.{NM}, 1, 5)",
    "l.research_organization_name_en = r.research_organization_name_en",
]


def _pairs_of(table: str, id: str, comparison: str) -> str:
    found = " UNION ALL ".join(
        f"SELECT l.{id} AS id_l, r.{id} AS id_r, {number} AS match_rule FROM {table} l JOIN {table} r "
        f"ON l.recipient_type = r.recipient_type AND {rule} AND l.{id} {comparison} r.{id}"
        for number, rule in enumerate(RULES, 1)
    )
    return f"SELECT id_l, id_r, min(match_rule)::BIGINT AS match_rule FROM ({found}) GROUP BY 1, 2"


PROFILE_PAIRS = f"""
SELECT p.*, CASE WHEN id_l = id_r THEN l.n * (l.n - 1) // 2 ELSE l.n * r.n END AS n_pairs
FROM ({_pairs_of('profiles', 'id', '<=')}) p JOIN profiles l ON l.id = id_l JOIN profiles r ON r.id = id_r
WHERE id_l < id_r OR l.n > 1
"""


def _similar(c: str, first: int) -> str:
    jw = f"jaro_winkler_similarity(l.{c}, r.{c})"
    return " ".join(
        f"WHEN {jw} >= {t} THEN {first + k}" for k, t in enumerate(V.NAME_SIMILARITY_LEVELS)
    )


def _level(c: str, kind: str) -> str:
    null = f"CASE WHEN l.{c} IS NULL OR r.{c} IS NULL THEN -1 WHEN l.{c} = r.{c} THEN 0"
    if kind == "exact":
        return f"{null} ELSE 1 END"
    if kind == "name":
        return f"{null} {_similar(c, 1)} ELSE 4 END"
    stripped = "recipient_legal_name_stripped_en"
    return f"{null} WHEN l.{stripped} = r.{stripped} THEN 1 {_similar(c, 2)} ELSE 5 END"


KINDS = {
    "recipient_legal_name_en": "custom",
    "recipient_legal_name_fr": "name",
    "recipient_operating_name_en": "name",
    "recipient_business_number": "exact",
    "recipient_postal_code": "exact",
    "recipient_city": "exact",
    "research_organization_name_en": "name",
}
VALUES = {"custom": CUSTOM, "name": NAME, "exact": EXACT}
TF = ["recipient_legal_name_en", "recipient_business_number", "recipient_postal_code"]
_codes = ", ".join(f"({_level(c, k)})::BIGINT AS g_{c}" for c, k in KINDS.items())
VECTORS = f"""
SELECT l.recipient_type, p.*, {_codes}
FROM profile_pairs p JOIN profiles l ON l.id = id_l JOIN profiles r ON r.id = id_r
"""
_tf_part = (
    "SELECT recipient_type, '{c}' AS \"column\", {c} AS value, "
    "count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY recipient_type) AS tf "
    "FROM records WHERE {c} IS NOT NULL GROUP BY recipient_type, {c}"
)
TERMS = " UNION ALL ".join(_tf_part.format(c=c) for c in TF)


def _weight(codes: str, trained: str = "") -> str:
    """Match weight from level codes, by the fixed parameters or those of a joined table that
    has lists of m and u by comparison."""
    parts = [f"log2({trained}.prior / (1 - {trained}.prior))" if trained else f"log2({PRIOR} / (1 - {PRIOR}))"]
    for c, kind in KINDS.items():
        m, u = VALUES[kind]
        if trained:
            shares = [(f"{trained}.m_{c}[{k + 1}]", f"{trained}.u_{c}[{k + 1}]") for k in range(len(m))]
        else:
            shares = [(f"{a}::DOUBLE", f"{b}::DOUBLE") for a, b in zip(m, u)]
        whens = " ".join(f"WHEN {k} THEN log2({a} / {b})" for k, (a, b) in enumerate(shares))
        parts.append(f"CASE {codes}.g_{c} {whens} ELSE 0 END")
        if c in TF:
            parts.append(f"CASE WHEN {codes}.g_{c} = 0 THEN log2({shares[0][1]} / t_{c}.tf) ELSE 0 END")
    return " + ".join(parts)


def _terms_joined(side: str) -> str:
    return " ".join(
        f"LEFT JOIN terms t_{c} ON t_{c}.\"column\" = '{c}' AND t_{c}.value = {side}.{c} "
        f"AND t_{c}.recipient_type = {side}.recipient_type"
        for c in TF
    )


SCORED = f"""
SELECT *, 1.0 / (1.0 + pow(2.0, -match_weight)) AS match_probability FROM (
  SELECT v.*, {_weight('v')} AS match_weight
  FROM vectors v JOIN profiles l ON l.id = v.id_l {_terms_joined('l')})
"""
# The same by single records: pairs, levels, scores and connected components.


def _record_scored(trained: str = "") -> str:
    joined = f"JOIN {trained} ON {trained}.shard = l.recipient_type" if trained else ""
    return f"""
SELECT id_l, id_r, 1.0 / (1.0 + pow(2.0, -({_weight('v', trained)}))) AS match_probability
FROM (SELECT p.*, {_codes} FROM ({_pairs_of('records', 'unique_id', '<')}) p
      JOIN records l ON l.unique_id = id_l JOIN records r ON r.unique_id = id_r) v
JOIN records l ON l.unique_id = v.id_l {_terms_joined('l')} {joined}
"""


RECORD_SCORED = _record_scored()


def _edges(scored: str) -> str:
    return f"""
SELECT id_l AS a, id_r AS b FROM {scored} WHERE match_probability >= 0.95
UNION ALL SELECT id_r, id_l FROM {scored} WHERE match_probability >= 0.95
"""


def _reached(name: str, edges: str) -> str:
    return f"""
SELECT unique_id AS id, unique_id AS label FROM records
UNION SELECT e.b, x.label FROM {name} x JOIN {edges} e ON x.id = e.a WHERE x.label < e.b
"""


def _clusters(reached: str) -> str:
    return f"""
SELECT r.*, c.cluster_id FROM records r JOIN
 (SELECT id, min(label) AS cluster_id FROM {reached} GROUP BY 1) c ON c.id = r.unique_id
"""


EDGES, REACHED, CLUSTERS = _edges("record_scored"), _reached("reached", "edges"), _clusters("reached")
TRUE_CLUSTERS = """
SELECT * EXCLUDE (gid), gid AS unique_id, min(gid) OVER (PARTITION BY truth) AS cluster_id FROM normalized
"""

_chain = [
    ("normalized", NORMALIZED, ["grants"]),
    ("classified", CLASSIFIED, ["normalized"]),
    ("verdicts", VERDICTS, ["classified"]),
    ("parsed", PARSED, ["verdicts"]),
    ("records", RECORDS, ["classified"]),
    ("profiles", PROFILES, ["records"]),
    ("profile_pairs", PROFILE_PAIRS, ["profiles"]),
    ("vectors", VECTORS, ["profile_pairs"]),
    ("terms", TERMS, ["records"]),
    ("scored", SCORED, ["vectors", "terms"]),
    ("record_scored", RECORD_SCORED, ["records", "terms"]),
    ("edges", EDGES, ["record_scored"]),
    ("reached", REACHED, ["edges"]),
    ("clusters", CLUSTERS, ["reached"]),
    ("true_clusters", TRUE_CLUSTERS, ["normalized"]),
]


def on(table: str, body: str, *more: str) -> str:
    """``body`` with the CTEs that lead to ``table`` (and to ``more``)."""
    wanted = {table, *more}
    for name, _, needs in reversed(_chain):
        if name in wanted:
            wanted.update(needs)
    ctes = [f"grants AS ({grants_sql()})"]
    ctes += [
        f"{name} AS {'' if name == 'reached' else 'MATERIALIZED '}({sql})"
        for name, sql, _ in _chain
        if name in wanted
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} {body}"


def add(name: str, table: str, body: str, *more: str) -> None:
    ORACLE[name] = on(table, body, *more)


# Sources

_text_columns = [
    "ref_number", "recipient_legal_name", "recipient_operating_name", "research_organization_name",
    "recipient_business_number", "recipient_city", "recipient_province", "recipient_country",
    "recipient_postal_code", "recipient_type", "owner_org", "prog_name_en", "naics_identifier",
]
add(
    "read_grants_csv", "grants",
    f"SELECT gid, truth, {', '.join(f'''nullif({c}, '') AS {c}''' for c in _text_columns)}, "
    "agreement_value, strftime(agreement_start_date::DATE, '%Y-%m-%d') AS agreement_start_date FROM grants",
)
add("write_read_stage", "normalized", f"SELECT gid, ref_number, {NM}, recipient_postal_code FROM normalized")
add(
    "snapshot_verdicts", "verdicts",
    f"SELECT *, llm_result_json IS NOT NULL AS success, '20240101T000000' AS backup_created_at, "
    "'some-model' AS model, 'some-endpoint' AS openai_base_url FROM verdicts",
)

# Profiling

_n_columns = len(_text_columns) + 4
add("table_shape", "grants", f"SELECT count(*) AS total_rows, {_n_columns}::BIGINT AS total_columns FROM grants")


def _complete(table: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER ({c} IS NULL) AS null_count, "
        f"count(*) FILTER ({strip(c)} = '') AS empty_count FROM {table}"
        for c in columns
    )
    return (
        f"SELECT \"column\", total, total - null_count - empty_count AS filled, null_count, empty_count, "
        f"{pct('total - null_count - empty_count', 'total')} AS fill_rate FROM ({parts})"
    )


add("completeness", "grants", _complete("grants", V.KEY_COLUMNS))
ORACLE["profile_documents"] = _complete("documents", ["text", "lang", "source"])
add(
    "null_summary", "normalized",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR {strip(c)} = '') AS null_count, "
        f"{pct(f'''count(*) FILTER ({c} IS NULL OR {strip(c)} = '')''', 'count(*)')} AS null_pct FROM normalized"
        for c in V.LINKAGE_TEXT_COLUMNS
    ),
)
_distribution = (
    "SELECT coalesce(nullif(recipient_type, ''), '(empty)') AS value, count(*) AS n, "
    f"{pct('count(*)', '(SELECT count(*) FROM grants)')} AS pct FROM grants GROUP BY 1"
)
add("value_distribution", "grants", _distribution)
_census = f"""
SELECT *, has_value - all_digits - has_rt_suffix - has_rp_suffix - placeholder AS other_format,
  {pct('has_value', 'total_rows')} AS coverage_pct FROM (
SELECT count(*) AS total_rows, count(*) FILTER (c IS NULL OR c = '') AS missing,
  count(*) FILTER (c <> '') AS has_value,
  count(*) FILTER (regexp_matches(c, '^\\p{{Nd}}+$')) AS all_digits,
  count(*) FILTER (c ILIKE '%rt%') AS has_rt_suffix, count(*) FILTER (c ILIKE '%rp%') AS has_rp_suffix,
  count(*) FILTER (c IN {_list(V.CENSUS_PLACEHOLDERS)}) AS placeholder
FROM (SELECT {strip('recipient_business_number')} AS c FROM grants))
"""
add("id_format_census", "grants", _census)
_separators = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (contains({c}, '|')) AS with_separator, "
    f"{pct(f'''count(*) FILTER (contains({c}, '|'))''', 'count(*)')} AS pct FROM grants"
    for c in V.BILINGUAL_COLUMNS
)
add("separator_census", "grants", _separators)
_top = (
    "SELECT coalesce(nullif(owner_org, ''), '(empty)') AS value, count(*) AS n FROM grants "
    "GROUP BY 1 ORDER BY n DESC, value LIMIT 20"
)
add("top_k_values", "grants", _top)
_names_census = (
    "SELECT *, distinct_exact - distinct_lower AS case_collisions FROM (SELECT "
    f"count(DISTINCT {strip('recipient_legal_name')}) AS distinct_exact, "
    f"count(DISTINCT lower({strip('recipient_legal_name')})) AS distinct_lower FROM grants)"
)
add("distinct_name_census", "grants", _names_census)
add(
    "key_uniqueness", "grants",
    "SELECT *, non_empty - distinct_keys AS duplicates, non_empty = distinct_keys AS all_unique FROM ("
    "SELECT count(*) AS total_rows, count(*) FILTER (k <> '') AS non_empty, "
    "count(DISTINCT k) FILTER (k <> '') AS distinct_keys "
    f"FROM (SELECT {strip('ref_number')} AS k FROM grants))",
)
add(
    "key_uniqueness_with_null", "grants",
    "SELECT *, total_rows - distinct_keys AS duplicates FROM (SELECT count(*) AS total_rows, "
    "count(DISTINCT recipient_business_number) + max(CASE WHEN recipient_business_number IS NULL THEN 1 ELSE 0 END) "
    "AS distinct_keys FROM grants)",
)
add(
    "duplicate_keys", "grants",
    f"SELECT {strip('ref_number')} AS key, count(*) AS n FROM grants GROUP BY 1 HAVING key <> '' AND n > 1",
)
add(
    "audit_filter", "grants",
    "SELECT ref_number, recipient_legal_name, recipient_type, owner_org FROM grants "
    "WHERE owner_org = 'org-7' AND recipient_type = 'N'",
)


def _any(term: str, columns: list[str]) -> str:
    return " OR ".join(f"regexp_matches({c}, '(?i){term}')" for c in columns)


add("search_any", "grants", f"SELECT gid, recipient_legal_name FROM grants WHERE {_any('university', V.NAME_COLUMNS)}")
add(
    "type_spread", "grants",
    "SELECT recipient_type, count(*) AS n, count(*) OVER () AS n_categories FROM grants "
    f"WHERE {_any('university', V.NAME_COLUMNS)} GROUP BY 1",
)
add(
    "sample_per_group", "grants",
    "SELECT recipient_type, gid FROM grants "
    "QUALIFY row_number() OVER (PARTITION BY recipient_type ORDER BY gid) <= 10",
)
add("head_sample", "grants", "SELECT gid, ref_number, recipient_legal_name FROM grants ORDER BY gid LIMIT 20")


def _long(section: str, key: str, metrics: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS key, '{m}' AS metric, ({m})::DOUBLE AS value FROM ({source})"
        for m in metrics
    )


_report = " UNION ALL ".join(
    [
        _long("shape", "NULL::VARCHAR", ["total_rows", "total_columns"],
              f"SELECT count(*) AS total_rows, {_n_columns} AS total_columns FROM grants"),
        _long("completeness", '"column"', ["total", "filled", "null_count", "empty_count", "fill_rate"],
              _complete("grants", V.KEY_COLUMNS)),
        _long("recipient_types", "value", ["n", "pct"], _distribution),
        _long("business_number_formats", "NULL::VARCHAR",
              ["total_rows", "missing", "has_value", "all_digits", "has_rt_suffix", "has_rp_suffix",
               "placeholder", "other_format", "coverage_pct"], _census),
        _long("bilingual_names", '"column"', ["with_separator", "pct"], _separators),
        _long("top_owner_orgs", "value", ["n"], _top),
        _long("unique_names", "NULL::VARCHAR",
              ["distinct_exact", "distinct_lower", "case_collisions"], _names_census),
    ]
)
add("profile_report", "grants", _report)
add("write_read_profile_report", "grants", _report)

# Normalising

add(
    "split_bilingual", "grants",
    "SELECT gid, string_split(recipient_legal_name, '|')[1] AS en, "
    "string_split(recipient_legal_name, '|')[2] AS fr FROM grants",
)
add("clean_name", "grants", f"SELECT gid, {clean('recipient_legal_name')} AS cleaned FROM grants")
add("normalize_names", "grants", f"SELECT gid, {_names} FROM grants")
add("normalize_business_number", "normalized", "SELECT gid, bn_raw, recipient_business_number FROM normalized")
add(
    "bn_summary", "normalized",
    f"SELECT *, {pct('valid', 'total_rows')} AS valid_pct, {pct('null_count', 'total_rows')} AS null_pct FROM ("
    "SELECT count(*) AS total_rows, count(recipient_business_number) AS valid, "
    "count(*) - count(recipient_business_number) AS null_count FROM normalized)",
)
add("normalize_postal_code", "normalized", "SELECT gid, postal_code_raw, recipient_postal_code FROM normalized")
add(
    "postal_summary", "normalized",
    f"SELECT *, {pct('domestic_valid', 'domestic')} AS domestic_valid_pct FROM (SELECT "
    f"count(*) FILTER ({_domestic}) AS domestic, "
    f"count(*) FILTER ({_domestic} AND recipient_postal_code IS NOT NULL) AS domestic_valid, "
    f"count(*) FILTER (NOT {_domestic}) AS foreign_rows FROM normalized)",
)
add("normalize_ref", "normalized", "SELECT gid, ref_number_raw, ref_number FROM normalized")
add(
    "ref_whitespace_count", "grants",
    "SELECT count(*) FILTER (regexp_matches(ref_number, '\\s')) AS with_whitespace FROM grants",
)
add(
    "blank_to_null", "grants",
    "SELECT gid, " + ", ".join(
        f"CASE WHEN {strip(c)} = '' THEN NULL ELSE {c} END AS {c}"
        for c in ["recipient_operating_name", "recipient_business_number", "recipient_type"]
    ) + " FROM grants",
)
_stripped = f"nullif(regexp_replace({strip(f'lower({NM})')}, '{_prefix_run}', ''), '')"
add("strip_common_prefixes", "normalized", f"SELECT gid, {_stripped} AS recipient_legal_name_stripped_en FROM normalized")
add(
    "prefix_strip_count", "normalized",
    f"SELECT count(*) FILTER ({_stripped} IS DISTINCT FROM lower({NM})) AS n_stripped FROM normalized",
)
add("normalize_grants", "normalized", "SELECT * EXCLUDE (agreement_start_date, agreement_value) FROM normalized")

# Rule labels

add("person_name", "normalized", f"SELECT gid, {_person} AS is_person FROM normalized")
add("apply_rules", "classified", "SELECT gid, rule_label FROM classified")
add(
    "classify_with_provenance", "classified",
    "SELECT gid, recipient_type_new, recipient_type_source, recipient_type_confidence FROM classified",
)
add(
    "label_fill", "normalized",
    f"SELECT *, {pct('filled', 'total_rows')} AS filled_pct, {pct('null_count', 'total_rows')} AS null_pct FROM ("
    "SELECT count(*) AS total_rows, count(recipient_type) AS filled, "
    "count(*) - count(recipient_type) AS null_count FROM normalized)",
)
add(
    "classification_coverage", "classified",
    f"SELECT *, {pct('total_rows - remaining', 'total_rows')} AS coverage_pct FROM (SELECT count(*) AS total_rows, "
    + ", ".join(
        f"count(*) FILTER (recipient_type_source = '{x}') AS {x}" for x in ("original", "deterministic", "llm")
    )
    + ", count(*) FILTER (recipient_type_source IS NULL) AS remaining FROM classified)",
)
add(
    "label_breakdown", "classified",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS label, count(*) AS n FROM classified GROUP BY 2"
        for c in ("recipient_type_source", "recipient_type_new")
    ),
)
add(
    "rule_breakdown", "classified",
    "SELECT recipient_type_new AS label, count(*) AS n FROM classified "
    "WHERE recipient_type_source = 'deterministic' GROUP BY 1",
)

# Verdicts

_residual = f"recipient_type_source IS NULL AND {NM} IS NOT NULL"
_contexts = (
    f"SELECT {NM}, bool_or(recipient_business_number IS NOT NULL) AS has_bn, count(*) AS n "
    f"FROM classified WHERE {_residual} GROUP BY 1"
)
_fields = [
    ("operating_name", "recipient_operating_name_en"),
    ("org", "owner_org"),
    ("program", "prog_name_en"),
    ("industry", "naics_identifier"),
]
_values = " UNION ALL ".join(
    f"SELECT {NM}, '{f}' AS field, {c} AS value, count(*) AS n FROM classified "
    f"WHERE {_residual} AND {c} IS NOT NULL GROUP BY 1, 3"
    for f, c in _fields
)
add("residual_contexts", "classified", _contexts)
add("context_values", "classified", _values)


def _shown(field: str, most: int) -> str:
    return (
        f"(SELECT string_agg(value, ', ' ORDER BY value) FROM (SELECT value FROM vals v WHERE v.{NM} = c.{NM} "
        f"AND v.field = '{field}' ORDER BY value LIMIT {most}))"
    )


_prompts = f"""
SELECT {NM}, n, 'name: ' || {NM} || coalesce(chr(10) || 'operating_as: ' || {_shown('operating_name', 2)}, '')
 || chr(10) || 'funded_by: ' || coalesce({_shown('org', 3)}, '')
 || coalesce(chr(10) || 'programs: ' || {_shown('program', 2)}, '')
 || coalesce(chr(10) || 'naics: ' || {_shown('industry', 2)}, '')
 || CASE WHEN has_bn THEN chr(10) || 'has_business_number: yes' ELSE '' END AS prompt FROM ctx c
"""


def add_prompts(name: str, body: str) -> None:
    ORACLE[name] = on(
        "classified",
        f", ctx AS ({_contexts}), vals AS ({_values}), prompts AS MATERIALIZED ({_prompts}) {body}",
    )


add_prompts("render_prompt", "SELECT * FROM prompts")
_place = f"row_number() OVER (PARTITION BY substr(md5({NM}), 1, 1) ORDER BY {NM}) - 1"
add_prompts(
    "make_batches",
    f"SELECT bucket, batch_no, string_agg({NM}, '; ' ORDER BY place) AS names, "
    "string_agg(prompt, chr(10) || '---' || chr(10) ORDER BY place) AS prompt FROM ("
    f"SELECT *, substr(md5({NM}), 1, 1) AS bucket, {_place} AS place, ({_place}) // 3 AS batch_no FROM prompts) "
    "GROUP BY 1, 2",
)
add_prompts(
    "score_batches",
    f"SELECT {NM} AS name, CASE length(prompt) % 5 WHEN 0 THEN 'http_error' WHEN 1 THEN 'exception' ELSE 'success' END AS status, "
    "CASE WHEN length(prompt) % 5 > 1 THEN '[{\"type\": \"N\", \"confidence\": 0.8}]' END AS result_json, "
    "(CASE length(prompt) % 5 WHEN 1 THEN 3 ELSE 1 END)::BIGINT AS attempts FROM prompts",
)
add(
    "verdict_cache", "verdicts",
    f"SELECT *, CASE WHEN {NM} < 'm' AND llm_result_json IS NOT NULL THEN 'before' ELSE 'now' END AS scored FROM verdicts",
)
add("parse_verdicts", "parsed", "SELECT * FROM parsed")
add(
    "scoring_summary", "verdicts",
    "SELECT count(llm_result_json) AS successes, count(*) - count(llm_result_json) AS failures FROM verdicts",
)
add("failure_sample", "verdicts", f"SELECT {NM} FROM verdicts WHERE llm_result_json IS NULL ORDER BY 1 LIMIT 5")
add("verdict_distribution", "parsed", "SELECT llm_type, count(*) AS n FROM parsed GROUP BY 1")
add(
    "low_confidence_queue", "parsed",
    f"SELECT * FROM parsed WHERE llm_confidence < 0.7 ORDER BY llm_confidence, {NM}, item_no LIMIT 20",
)
add(
    "merge_verdicts", "parsed",
    "SELECT gid, coalesce(recipient_type_new, llm_type) AS recipient_type, "
    "coalesce(recipient_type_source, CASE WHEN llm_type IS NOT NULL THEN 'llm' END) AS recipient_type_source, "
    "coalesce(recipient_type_confidence, llm_confidence) AS recipient_type_confidence "
    f"FROM classified c LEFT JOIN (SELECT * FROM parsed WHERE llm_type IS NOT NULL "
    f"QUALIFY row_number() OVER (PARTITION BY {NM} ORDER BY item_no) = 1) p ON c.{NM} = p.{NM}",
)

# Linkage

add(
    "with_unique_id", "grants",
    "SELECT count(*) AS n, 0::BIGINT AS least, count(*) - 1 AS greatest, count(*) AS n_distinct FROM grants",
)
add("shard_filter", "records", "SELECT unique_id, recipient_type, recipient_legal_name_stripped_en FROM records")
add("collapse_profiles", "profiles", "SELECT id, n, recipient_type FROM profiles")
add("block_pairs", "profile_pairs", "SELECT * FROM profile_pairs WHERE id_l < id_r")
add(
    "candidate_totals", "records",
    f"SELECT match_rule, count(*) AS n_pairs FROM ({_pairs_of('records', 'unique_id', '<')}) GROUP BY 1",
)
_block_keys = [
    ["recipient_business_number"],
    [NM, "recipient_postal_code"],
    [NM, "recipient_city"],
    ["recipient_postal_code", f"substr({NM}, 1, 6)"],
    ["recipient_city", f"substr({NM}, 1, 5)"],
    ["research_organization_name_en"],
]
add(
    "block_size_report", "profiles",
    " UNION ALL ".join(
        f"SELECT {number}::BIGINT AS match_rule, count(*) AS blocks, sum(n * (n - 1) // 2)::BIGINT AS record_pairs, "
        f"sum(k * (k - 1) // 2)::BIGINT AS profile_pairs, max(n)::BIGINT AS largest_block FROM ("
        f"SELECT sum(n) AS n, count(*) AS k FROM profiles WHERE {' AND '.join(x + ' IS NOT NULL' for x in keys)} "
        f"GROUP BY recipient_type, {', '.join(keys)})"
        for number, keys in enumerate(_block_keys, 1)
    ),
)
add(
    "jaro_winkler_pairs", "profile_pairs",
    "SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM (SELECT DISTINCT "
    f"l.{NM} AS a, r.{NM} AS b FROM profile_pairs JOIN profiles l ON l.id = id_l JOIN profiles r ON r.id = id_r "
    "WHERE id_l < id_r) WHERE a IS NOT NULL AND b IS NOT NULL",
)
for _name, _column in (
    ("compare_exact", "recipient_city"),
    ("compare_name", "recipient_operating_name_en"),
    ("compare_custom", NM),
):
    add(_name, "vectors", f"SELECT id_l, id_r, g_{_column} AS level FROM vectors")
add("comparison_vectors", "vectors", "SELECT * FROM vectors")
add("term_frequencies", "terms", "SELECT * REPLACE (round(tf, 9) AS tf) FROM terms")

# Training, scoring and clustering

_a, _b = "recipient_business_number", f"{NM}, recipient_postal_code"


def _caught(keys: str) -> str:
    there = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return (
        f"SELECT recipient_type, sum(k * (k - 1) / 2) AS c FROM (SELECT recipient_type, count(*) AS k "
        f"FROM records WHERE {there} GROUP BY recipient_type, {keys}) GROUP BY 1"
    )


_priors = (
    "SELECT s.recipient_type, greatest(1e-7, least(1 - 1e-7, "
    "(coalesce(a.c, 0) + coalesce(b.c, 0) - coalesce(ab.c, 0)) / 0.7 / (s.n * (s.n - 1) / 2))) AS prior "
    "FROM (SELECT recipient_type, count(*) AS n FROM records GROUP BY 1) s "
    f"LEFT JOIN ({_caught(_a)}) a USING (recipient_type) LEFT JOIN ({_caught(_b)}) b USING (recipient_type) "
    f"LEFT JOIN ({_caught(_a + ', ' + _b)}) ab USING (recipient_type)"
)
add("estimate_prior", "records", f"SELECT * REPLACE (round(prior, 9) AS prior) FROM ({_priors})")


def _u_part(c: str, kind: str) -> str:
    """Levels of pairs: exact ones from block sizes of whole tables, others from the sample."""
    if kind == "exact":
        return (
            f"SELECT shard, '{c}' AS comparison, unnest([0, 1])::BIGINT AS level, unnest([same, every - same])::BIGINT AS pairs "
            f"FROM (SELECT recipient_type AS shard, sum(n * (n - 1) // 2) AS same, sum(n) * (sum(n) - 1) // 2 AS every "
            f"FROM (SELECT recipient_type, {c}, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY 1)"
        )
    return (
        f"SELECT l.recipient_type AS shard, '{c}' AS comparison, ({_level(c, kind)})::BIGINT AS level, count(*) AS pairs "
        f"FROM sample l JOIN sample r ON l.recipient_type = r.recipient_type AND l.unique_id < r.unique_id "
        f"WHERE l.{c} IS NOT NULL AND r.{c} IS NOT NULL GROUP BY 1, 3"
    )


def _u_whole(c: str, kind: str) -> str:
    """Levels of all pairs of records, by pairs of distinct values."""
    if kind == "exact":
        return _u_part(c, kind)
    columns = f"{c}, recipient_legal_name_stripped_en" if kind == "custom" else c
    return (
        f"SELECT shard, '{c}' AS comparison, level, sum(pairs)::BIGINT AS pairs FROM ("
        f"WITH v AS MATERIALIZED (SELECT recipient_type, {columns}, count(*) AS n, row_number() OVER () AS i "
        f"FROM records WHERE {c} IS NOT NULL GROUP BY ALL) "
        f"SELECT l.recipient_type AS shard, ({_level(c, kind)})::BIGINT AS level, "
        "sum(CASE WHEN l.i = r.i THEN l.n * (l.n - 1) // 2 ELSE l.n * r.n END) AS pairs "
        "FROM v l JOIN v r ON l.recipient_type = r.recipient_type AND l.i <= r.i GROUP BY 1, 2) GROUP BY 1, 3"
    )


def _u_table(part) -> str:
    parts = " UNION ALL ".join(f"SELECT * FROM ({part(c, k)}) WHERE pairs > 0" for c, k in KINDS.items())
    return f"SELECT *, pairs::DOUBLE / sum(pairs) OVER (PARTITION BY shard, comparison) AS u FROM ({parts})"


_shown_u = "SELECT * REPLACE (round(u, 9) AS u) FROM"
ORACLE["estimate_u"] = on("records", f"{_shown_u} ({_u_table(_u_whole)})")
ORACLE["estimate_u_sampled"] = on(
    "records",
    ", sample AS MATERIALIZED (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY recipient_type "
    f"ORDER BY md5('0:' || unique_id), unique_id) <= 1000) {_shown_u} ({_u_table(_u_part)})",
)
_gammas = ", ".join(f"g_{c}" for c in KINDS)
_patterns = (
    f"SELECT recipient_type, {_gammas}, sum(n_pairs)::BIGINT AS n_pairs, count(*) AS n_rows FROM vectors GROUP BY ALL"
)
add("gamma_patterns", "vectors", _patterns)


def _odds(fixed: list[str]) -> str:
    parts = [f"({PRIOR} / (1 - {PRIOR}))::DOUBLE"]
    for c, kind in KINDS.items():
        if c not in fixed:
            m, u = VALUES[kind]
            whens = " ".join(f"WHEN {k} THEN {m[k]}::DOUBLE / {u[k]}::DOUBLE" for k in range(len(m)))
            parts.append(f"CASE g_{c} {whens} ELSE 1 END")
    return " * ".join(parts)


def _session(number: int, fixed: list[str]) -> str:
    equal = " AND ".join(f"g_{c} = 0" for c in fixed)
    sums = ", ".join(
        f"round(sum(CASE WHEN g_{c} = {k} THEN n_pairs * w ELSE 0 END), 4) AS g_{c}_{k}"
        for c, kind in KINDS.items()
        for k in range(len(VALUES[kind][0]))
    )
    return (
        f"SELECT {number}::BIGINT AS session, recipient_type AS shard, round(sum(n_pairs)::DOUBLE, 4) AS pairs, "
        f"round(sum(n_pairs * w), 4) AS \"true\", {sums} FROM (SELECT *, o / (o + 1) AS w FROM "
        f"(SELECT *, {_odds(fixed)} AS o FROM patterns WHERE {equal})) GROUP BY 2"
    )


ORACLE["em_round"] = on(
    "vectors",
    f", patterns AS ({_patterns}) {_session(0, [_a])} UNION ALL {_session(1, _b.split(', '))}",
)


def _clamped(x: str) -> str:
    return f"greatest(1e-7, least(1 - 1e-7, {x}))"


_LEVELS = {c: len(VALUES[kind][0]) for c, kind in KINDS.items()}
_SESSIONS = [[_a], _b.split(", ")]
_codes_of = " UNION ALL ".join(
    f"SELECT '{c}' AS comparison, unnest(range({k})) AS level, {k} AS levels" for c, k in _LEVELS.items()
)


def _free(c: str) -> str:
    """Whether the session trains the comparison."""
    held = [str(i) for i, fixed in enumerate(_SESSIONS) if c in fixed]
    return f"session NOT IN ({', '.join(held)})" if held else "true"


def _em(priors: str, u: str) -> str:
    """CTEs that train from tables ``(shard, prior)`` and ``(shard, comparison, level, u)``.

    ``em`` holds a row for each session, type and round, its shares as lists; a session goes on
    until no share moves by 1e-4. ``trained`` is where each ends, and ``shares`` m of both sessions.
    """
    lists = ", ".join(f"list(u ORDER BY level) FILTER (comparison = '{c}') AS u_{c}" for c in KINDS)
    starts = []
    for number, fixed in enumerate(_SESSIONS):
        odds = " * ".join(["prior / (1 - prior)", *[f"0.95::DOUBLE / {_clamped(f'u_{c}[1]')}" for c in fixed]])
        starts.append(f"SELECT {number} AS session, *, {odds} AS odds FROM u_lists JOIN priors USING (shard)")
    first = ", ".join(
        f"[0.95::DOUBLE, {', '.join([f'0.05::DOUBLE / {k - 1}'] * (k - 1))}] AS m_{c}, false AS t_{c}" for c, k in _LEVELS.items()
    )
    kept_u = ", ".join(f"u_{c}" for c in KINDS)
    ratio = " * ".join(
        f"CASE WHEN g_{c} < 0 OR NOT ({_free(c)}) THEN 1.0::DOUBLE ELSE {_clamped(f'm_{c}[g_{c} + 1]')} / {_clamped(f'u_{c}[g_{c} + 1]')} END"
        for c in KINDS
    )
    sums = ", ".join(
        "[" + ", ".join(f"sum(CASE WHEN g_{c} = {k} THEN n_pairs * w ELSE 0 END)" for k in range(n)) + f"] AS a_{c}"
        for c, n in _LEVELS.items()
    )
    carried = ", ".join(f"any_value({x}_{c}) AS {x}_{c}" for c in KINDS for x in ("m", "t", "u"))
    moves = {c: f"(({_free(c)}) AND list_sum(a_{c}) > 1e-7)" for c in KINDS}
    new = {c: f"list_transform(a_{c}, lambda x: {_clamped(f'x / list_sum(a_{c})')})" for c in KINDS}
    moved = ", ".join(
        f"CASE WHEN {moves[c]} THEN {new[c]} ELSE m_{c} END AS m_{c}, t_{c} OR {moves[c]} AS t_{c}" for c in KINDS
    )
    change = ", ".join(
        f"CASE WHEN {moves[c]} THEN list_max(list_transform(list_zip({new[c]}, m_{c}), lambda x: abs(x[1] - x[2]))) ELSE 0 END"
        for c in KINDS
    )
    long = " UNION ALL ".join(
        f"SELECT session, shard, rounds, prior, '{c}' AS comparison, unnest(range({n})) AS level, unnest(m_{c}) AS m, t_{c} AS trained FROM last"
        for c, n in _LEVELS.items()
    )
    known_u = _clamped(
        "coalesce(CASE WHEN bool_or(u IS NOT NULL) OVER (PARTITION BY shard, comparison) "
        "THEN coalesce(u, 0) END, others, 1.0::DOUBLE / levels)"
    )
    return f"""
, patterns AS MATERIALIZED ({_patterns}),
held AS MATERIALIZED (SELECT session, p.* EXCLUDE (recipient_type), recipient_type AS shard FROM patterns p, (VALUES (0), (1)) t(session)
  WHERE CASE session {' '.join(f"WHEN {i} THEN {' AND '.join(f'g_{c} = 0' for c in fixed)}" for i, fixed in enumerate(_SESSIONS))} END),
priors AS MATERIALIZED ({priors}),
u_seen AS MATERIALIZED ({u}),
u_full AS MATERIALIZED (SELECT shard, comparison, level, {known_u} AS u
  FROM priors CROSS JOIN ({_codes_of}) LEFT JOIN u_seen USING (shard, comparison, level)
  LEFT JOIN (SELECT comparison, level, coalesce(sum(u), 0) / any_value(k) AS others FROM ({_codes_of})
    JOIN (SELECT comparison, count(DISTINCT shard) AS k FROM u_seen GROUP BY 1) USING (comparison)
    LEFT JOIN u_seen USING (comparison, level) GROUP BY 1, 2) USING (comparison, level)),
u_lists AS MATERIALIZED (SELECT shard, {lists} FROM u_full GROUP BY 1),
em AS (SELECT session, shard, 0 AS rounds, false AS settled, {_clamped('odds / (1 + odds)')} AS prior, {first}, {kept_u}
  FROM ({' UNION ALL '.join(starts)})
UNION ALL SELECT session, shard, rounds + 1, greatest({change}) < 1e-4, CASE WHEN pairs > 0 THEN {_clamped('likely / pairs')} ELSE prior END, {moved}, {kept_u}
  FROM (SELECT session, shard, any_value(rounds) AS rounds, any_value(prior) AS prior, {carried}, sum(n_pairs)::DOUBLE AS pairs,
      sum(n_pairs * w) AS likely, {sums} FROM (SELECT *, o / (o + 1) AS w FROM
      (SELECT *, prior / (1 - prior) * {ratio} AS o FROM em JOIN held USING (session, shard) WHERE NOT settled AND rounds < 200))
    GROUP BY session, shard)),
last AS MATERIALIZED (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY session, shard ORDER BY rounds DESC) = 1),
trained AS MATERIALIZED ({long}),
own AS MATERIALIZED (SELECT shard, comparison, level, avg(m) AS m FROM trained WHERE trained GROUP BY ALL),
shares AS MATERIALIZED (SELECT shard, comparison, level, coalesce(o.m, x.m, CASE level WHEN 0 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE / (levels - 1) END) AS m
  FROM priors CROSS JOIN ({_codes_of}) LEFT JOIN own o USING (shard, comparison, level)
  LEFT JOIN (SELECT comparison, level, avg(m) AS m FROM own GROUP BY ALL) x USING (comparison, level)),
params AS MATERIALIZED (SELECT shard, comparison, level, {_clamped('m')} AS m, u, prior FROM shares
  JOIN u_full USING (shard, comparison, level) JOIN priors USING (shard))
"""


_fixed_em = _em(
    f"SELECT unnest([{', '.join(repr(x) for x in V.RECIPIENT_TYPES)}]) AS shard, {PRIOR}::DOUBLE AS prior",
    "SELECT shard, comparison, unnest(range(len(us))) AS level, unnest(us)::DOUBLE AS u FROM priors, (VALUES "
    + ", ".join(f"('{c}', {VALUES[kind][1]})" for c, kind in KINDS.items()) + ") t(comparison, us)",
)
ORACLE["em_train"] = on("vectors", _fixed_em + (
    "SELECT session::BIGINT AS session, shard, rounds::BIGINT AS rounds, round(prior, 6) AS prior, comparison, level, "
    "round(m, 6) AS m, trained FROM trained"
))
ORACLE["combine_sessions"] = on("vectors", _fixed_em + "SELECT shard, comparison, level, round(m, 6) AS m FROM shares")
_whole_em = _em(
    f"SELECT recipient_type AS shard, prior FROM ({_priors}) WHERE shard IN (SELECT recipient_type FROM records GROUP BY 1 HAVING count(*) > 1)",
    _u_table(_u_whole),
)
ORACLE["trained_parameters"] = ORACLE["save_load_model"] = on("vectors", _whole_em + (
    "SELECT shard, comparison, level, round(m, 6) AS m, round(u, 9) AS u, round(prior, 9) AS prior FROM params"
), "records")
_weights = ", ".join(f"list({x} ORDER BY level) FILTER (comparison = '{c}') AS {x}_{c}" for c in KINDS for x in ("m", "u"))
TRAINED_CLUSTERS = _whole_em + f"""
, weights AS MATERIALIZED (SELECT shard, any_value(prior) AS prior, {_weights} FROM params GROUP BY 1),
likely AS MATERIALIZED ({_record_scored('weights')}),
linked AS MATERIALIZED ({_edges('likely')}),
led AS ({_reached('led', 'linked')}),
found AS MATERIALIZED ({_clusters('led')})
"""
ORACLE["link_and_cluster"] = on(
    "vectors", TRAINED_CLUSTERS + f"SELECT unique_id, cluster_id, recipient_type, {NM} FROM found", "records", "terms"
)
add(
    "score_pairs", "scored",
    "SELECT id_l, id_r, n_pairs, round(match_weight, 6) AS match_weight, "
    "round(match_probability, 5) AS match_probability FROM scored WHERE match_probability >= 0.5",
)
add("cluster_pairs", "clusters", """
, linked AS (SELECT id_l AS a, id_r AS b FROM scored WHERE match_probability >= 0.95 AND id_l <> id_r
  UNION ALL SELECT id_r, id_l FROM scored WHERE match_probability >= 0.95 AND id_l <> id_r),
seen AS (SELECT id, id AS label FROM profiles
  UNION SELECT e.b, x.label FROM seen x JOIN linked e ON x.id = e.a WHERE x.label < e.b)
SELECT id, min(label) AS cluster_id FROM seen GROUP BY 1
""", "scored")
ORACLE["reachable_pairs"] = ORACLE["score_pairs"]
add("cluster_records", "clusters", "SELECT unique_id, cluster_id FROM clusters")
ORACLE["link_with_fixed_parameters"] = ORACLE["cluster_records"]
add(
    "assign_cluster_ids", "clusters",
    "SELECT unique_id, dense_rank() OVER (ORDER BY cluster_id) - 1 AS cluster_id FROM clusters",
)
add(
    "shard_report", "clusters",
    "SELECT t.recipient_type, coalesce(a.n, 0) AS n_rows, CASE WHEN coalesce(a.n, 0) < 2 THEN coalesce(a.n, 0) "
    "ELSE coalesce(b.k, 0) END AS entities, CASE WHEN coalesce(a.n, 0) < 2 THEN 'skipped (too few)' ELSE 'ok' END AS status "
    f"FROM (SELECT unnest([{', '.join(repr(x) for x in V.RECIPIENT_TYPES)}]) AS recipient_type) t "
    "LEFT JOIN (SELECT recipient_type_new AS recipient_type, count(*) AS n FROM classified GROUP BY 1) a USING (recipient_type) "
    "LEFT JOIN (SELECT recipient_type, count(DISTINCT cluster_id) AS k FROM clusters GROUP BY 1) b USING (recipient_type)",
)
add(
    "linkage_totals", "clusters",
    f"SELECT *, {pct('rows_processed - entities', 'rows_processed')} AS reduction_pct FROM (SELECT "
    "(SELECT count(*) FROM classified) AS rows_processed, count(*) AS rows_linked, "
    "count(DISTINCT cluster_id) AS entities FROM clusters)",
)

# Verification

add(
    "attach_attributes", "true_clusters",
    "SELECT unique_id, cluster_id, recipient_type, recipient_city, owner_org FROM true_clusters",
)
_sizes = "SELECT cluster_id, count(*) AS size FROM true_clusters GROUP BY 1"
add(
    "cluster_overview", "true_clusters",
    f"SELECT *, {pct('singletons', 'n_clusters')} AS singleton_pct, "
    f"{pct('total_rows - n_clusters', 'total_rows')} AS reduction_pct FROM ("
    "SELECT sum(size)::BIGINT AS total_rows, count(*) AS n_clusters, round(sum(size) / count(*), 1) AS mean_size, "
    "median(size)::DOUBLE AS median_size, max(size) AS max_size, count(*) FILTER (size = 1) AS singletons "
    f"FROM ({_sizes}))",
)
add("cluster_size_histogram", "true_clusters", f"SELECT size, count(*) AS n_clusters FROM ({_sizes}) GROUP BY 1")
add(
    "cluster_size_buckets", "true_clusters",
    "SELECT bucket_no, ['1 (singleton)', '2', '3-5', '6-10', '11-20', '21-50', '51-100', '100+'][bucket_no + 1] AS size_bucket, "
    f"count(*) AS n_clusters, sum(size)::BIGINT AS total_rows, "
    f"{pct('sum(size)', '(SELECT count(*) FROM true_clusters)')} AS pct_of_rows FROM (SELECT size, "
    "((size > 1)::INT + (size > 2)::INT + (size > 5)::INT + (size > 10)::INT + (size > 20)::INT + (size > 50)::INT "
    f"+ (size > 100)::INT)::BIGINT AS bucket_no FROM ({_sizes})) GROUP BY 1",
)
_largest = f"SELECT * FROM ({_sizes}) ORDER BY size DESC, cluster_id LIMIT 20"
add("largest_clusters", "true_clusters", _largest)
add(
    "largest_cluster_detail", "true_clusters",
    f"SELECT cluster_id, unique_id, {NM}, recipient_type FROM true_clusters "
    f"WHERE cluster_id IN (SELECT cluster_id FROM ({_largest}))",
)
_mixed = (
    "SELECT cluster_id, count(DISTINCT coalesce(recipient_type, '(null)')) AS n_types, count(*) AS size "
    "FROM true_clusters GROUP BY 1 HAVING n_types > 1"
)
add("cross_type_clusters", "true_clusters", _mixed)
add(
    "cross_type_summary", "true_clusters",
    f"SELECT *, {pct('n_inconsistent', 'entities')} AS pct_inconsistent FROM (SELECT "
    f"(SELECT count(*) FROM ({_mixed})) AS n_inconsistent, (SELECT count(DISTINCT cluster_id) FROM true_clusters) AS entities)",
)
add(
    "cross_type_detail", "true_clusters",
    "SELECT cluster_id, unique_id, recipient_type FROM true_clusters WHERE cluster_id IN (SELECT cluster_id "
    f"FROM ({_mixed}) ORDER BY n_types DESC, size DESC, cluster_id LIMIT 10)",
)
add(
    "cross_type_after_linking", "clusters",
    "SELECT 0::BIGINT AS n_inconsistent, count(DISTINCT cluster_id) AS entities, 0.0::DOUBLE AS pct_inconsistent FROM clusters",
)


def _reduced(key: str, tail: str = "") -> str:
    return (
        f"SELECT *, total_rows - entities AS rows_eliminated, {pct('total_rows - entities', 'total_rows')} AS reduction_pct "
        f"FROM (SELECT {key}, count(*) AS total_rows, count(DISTINCT cluster_id) AS entities FROM true_clusters GROUP BY 1) {tail}"
    )


add("reduction_by_type", "true_clusters", _reduced("recipient_type"))
add("reduction_by_owner", "true_clusters", _reduced("owner_org", "ORDER BY total_rows DESC, owner_org LIMIT 30"))
_found = _any("town of b", [NM, "recipient_operating_name_en", "research_organization_name_en"])
add(
    "entity_search", "true_clusters",
    f"SELECT cluster_id, unique_id, {NM} FROM true_clusters WHERE cluster_id IN "
    f"(SELECT cluster_id FROM true_clusters WHERE {_found})",
)
add(
    "search_counts", "true_clusters",
    f"SELECT count(*) AS matches, count(DISTINCT cluster_id) AS entities FROM true_clusters WHERE {_found}",
)
add(
    "sample_clusters", "true_clusters",
    f"SELECT cluster_id, unique_id, {NM} FROM true_clusters WHERE cluster_id IN (SELECT cluster_id FROM "
    "(SELECT DISTINCT cluster_id FROM true_clusters) ORDER BY md5(cluster_id || ':42'), cluster_id LIMIT 10)",
)

# Canonical names


def _mode(column: str, keep: str) -> str:
    return (
        f"SELECT cluster_id, {column} FROM true_clusters {keep} GROUP BY 1, 2 QUALIFY row_number() OVER "
        f"(PARTITION BY cluster_id ORDER BY count(*) DESC, {column} IS NULL, {column}) = 1"
    )


_suffix = "CASE recipient_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in V.LABEL_SUFFIXES.items()
) + " ELSE '' END"
_legal = _mode("recipient_legal_name", "")
_research = _mode("research_organization_name", "WHERE research_organization_name IS NOT NULL")
add(
    "most_frequent", "true_clusters",
    f"SELECT cluster_id, recipient_legal_name, research_organization_name FROM ({_legal}) LEFT JOIN ({_research}) USING (cluster_id)",
)
_entities = (
    f"SELECT cluster_id, coalesce(research_organization_name, recipient_legal_name) || {_suffix} AS canonical_name, "
    "recipient_type, total_funding, grant_count FROM ("
    "SELECT t.cluster_id, any_value(f.recipient_type) AS recipient_type, "
    "round(coalesce(sum(agreement_value), 0), 2) AS total_funding, count(*) AS grant_count "
    "FROM true_clusters t LEFT JOIN (SELECT cluster_id, recipient_type FROM true_clusters WHERE unique_id = cluster_id) f "
    f"USING (cluster_id) GROUP BY 1) JOIN ({_legal}) USING (cluster_id) LEFT JOIN ({_research}) USING (cluster_id)"
)
add("canonical_entities", "true_clusters", _entities)
# The same over the linked clusters; empty texts of the raw columns are null once linked.
ORACLE["canonical_grants"] = on(
    "vectors",
    TRAINED_CLUSTERS + ", named AS MATERIALIZED (SELECT c.* EXCLUDE (gid, recipient_type, recipient_type_new), "
    "c.gid AS unique_id, f.recipient_type, f.cluster_id FROM classified c JOIN found f ON f.unique_id = c.gid) "
    + _entities.replace("true_clusters", "named"),
    "records", "terms", "classified",
)
# A CSV does not tell empty texts from missing ones.
_read_back = ", ".join(f"nullif({c}, '') AS {c}" for c in _text_columns)
ORACLE["entities_from_csv"] = ORACLE["canonical_grants"].replace(
    f"grants AS ({grants_sql()})",
    f"exported AS ({grants_sql()}), grants AS (SELECT * REPLACE ({_read_back}) FROM exported)", 1,
)
