"""SQL counterparts of the registered queries, written for DuckDB and independent of the operators.

They follow the definitions by brute force: every pair of texts, plain windows over all rows.
"""

from __future__ import annotations

from caselink.functions.text import ENGLISH_STOP_WORDS
from caselink.operators import evaluation, linkage, prepare
from caselink.plans import catalog, evaluation_run
from caselink.schema import FEATURES
from caselink.sources import cases

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def _part(name: str, needs: tuple[str, ...], sql: str) -> None:
    _PARTS[name] = (needs, sql)


def _with(needs: tuple[str, ...], select: str) -> str:
    """``select`` behind the named parts and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in _PARTS[name][0]:
            visit(inner)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in order) + "\n" + select


_ORDERS = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

_part(
    "cases",
    (),
    f"""
SELECT o_orderkey AS dr_no, o_orderdate AS datetime, n_name AS area_name,
       CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN NULL
            ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS crm_cd,
       substr(o_orderpriority, 3) AS crm_cd_desc,
       nullif(c_mktsegment, 'FURNITURE') AS weapon_desc,
       CASE WHEN floor(c_acctbal / 100) >= -5 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS vict_age,
       CASE WHEN o_totalprice <= 450000 THEN o_orderstatus END AS vict_sex,
       lower(substr(o_orderpriority, 3)) || ' ' ||
       coalesce(lower(nullif(c_mktsegment, 'FURNITURE')), 'nan') || ' ' || lower(n_name) AS mo_text
FROM {_ORDERS}""",
)
_part(
    "raw_once",
    (),
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS dr_no,
       strftime(o_orderdate, '%m/%d/%Y') AS date_rptd,
       CASE WHEN o_totalprice < 20000 THEN 'not recorded'
            WHEN o_totalprice < 40000 THEN NULL
            WHEN o_totalprice < 60000 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN o_custkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00.000')
            WHEN o_custkey % 7 = 1 THEN strftime(o_orderdate, '%Y-%m-%d 10:00:00.123')
            WHEN o_custkey % 7 = 2 THEN strftime(o_orderdate, '%-m/%-d/%Y')
            WHEN o_custkey % 7 = 3 THEN strftime(o_orderdate, '%Y/%m/%d')
            WHEN o_custkey % 7 = 4 THEN strftime(o_orderdate, '%m/%d/%Y') || ' 9:30:00 AM'
            ELSE strftime(o_orderdate, '%m/%d/%Y') || ' 01:30:00 PM' END AS date_occ,
       upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS area_name,
       substr(o_orderpriority, 1, 1) AS crm_cd,
       substr(o_orderpriority, 3) AS crm_cd_desc,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'nan' ELSE nullif(c_mktsegment, 'FURNITURE') END AS weapon_desc,
       CAST(CAST(floor(c_acctbal / 100) AS INTEGER) AS VARCHAR) || CASE WHEN o_custkey % 3 = 0 THEN '.0' ELSE '' END AS vict_age,
       CASE WHEN o_totalprice <= 450000 THEN o_orderstatus END AS vict_sex
FROM {_ORDERS}""",
)
_part(
    "raw",
    ("raw_once",),
    """
SELECT * FROM raw_once
UNION ALL SELECT * REPLACE (NULL AS weapon_desc) FROM raw_once WHERE CAST(dr_no AS BIGINT) % 100 = 1""",
)
_part(
    "dated",
    ("raw",),
    """
SELECT *, coalesce(
  try_strptime(date_occ, ['%m/%d/%Y %I:%M:%S %p', '%Y-%m-%d', '%Y-%m-%dT%H:%M:%S.%g', '%Y-%m-%d %H:%M:%S.%g', '%m/%d/%Y', '%Y/%m/%d'])) AS occurred
FROM raw WHERE occurred IS NOT NULL""",
)
_MO_TEXT = """lower(crm_cd_desc) || ' ' || coalesce(lower(weapon_desc), 'nan') || ' ' || lower(area_name)"""
_part(
    "prepared",
    ("dated",),
    f"""
SELECT CAST(dr_no AS BIGINT) AS dr_no, CAST(CAST(occurred AS DATE) AS TIMESTAMP) AS datetime, area_name,
       CAST(crm_cd AS INTEGER) AS crm_cd, crm_cd_desc,
       CASE WHEN weapon_desc = 'nan' THEN 'unknown' ELSE weapon_desc END AS weapon_desc,
       CAST(CAST(vict_age AS DOUBLE) AS INTEGER) AS vict_age, vict_sex, {_MO_TEXT} AS mo_text
FROM dated""",
)
_UNIQUE = """SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY dr_no ORDER BY datetime DESC NULLS LAST,
  area_name DESC NULLS LAST, crm_cd DESC NULLS LAST, crm_cd_desc DESC NULLS LAST, weapon_desc DESC NULLS LAST,
  vict_age DESC NULLS LAST, vict_sex DESC NULLS LAST, mo_text DESC NULLS LAST) = 1"""
_part("unique_prepared", ("prepared",), _UNIQUE.format("prepared"))
_part(
    "typed",
    ("prepared",),
    "SELECT * REPLACE (CASE WHEN weapon_desc = 'unknown' THEN 'nan' ELSE weapon_desc END AS weapon_desc) FROM prepared",
)
_part("unique_typed", ("typed",), _UNIQUE.format("typed"))
_part("timed", (), "SELECT event_id AS dr_no, ts AS datetime, event_type AS crm_cd_desc FROM events")
_part(
    "docs",
    (),
    """
SELECT d.doc_id AS dr_no, ts AS datetime, source AS area_name,
       CAST(length(CAST(n_chars AS VARCHAR)) AS INTEGER) AS crm_cd,
       'length ' || length(CAST(n_chars AS VARCHAR)) AS crm_cd_desc, lang AS weapon_desc,
       CAST(20 + 10 * quality + 5 * toxic AS INTEGER) AS vict_age, CAST(quality AS VARCHAR) AS vict_sex, text AS mo_text
FROM documents d LEFT JOIN events ON d.doc_id = event_id LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)


def _tfidf_parts(prefix: str, source: str) -> None:
    """Tokens, idf and weights per distinct text of ``source``."""
    p = prefix
    _part(f"{p}texts", (source,), f"SELECT mo_text, count(*) AS n_rows FROM {source} GROUP BY mo_text")
    _part(
        f"{p}tf",
        (f"{p}texts",),
        f"""
SELECT mo_text, n_rows, term, count(*) AS tf FROM (
  SELECT mo_text, n_rows, unnest(regexp_extract_all(lower(mo_text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {p}texts)
WHERE term NOT IN ({_STOP}) GROUP BY ALL""",
    )
    _part(
        f"{p}idf",
        (f"{p}tf",),
        f"""
SELECT term, CAST(sum(n_rows) AS BIGINT) AS df,
       ln((1 + (SELECT count(*) FROM {source})) / (1 + sum(n_rows))) + 1 AS idf
FROM {p}tf GROUP BY term""",
    )
    _part(
        f"{p}weights",
        (f"{p}idf",),
        f"""
SELECT mo_text, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY mo_text)) AS weight
FROM {p}tf JOIN {p}idf USING (term)""",
    )


_tfidf_parts("", "cases")
_tfidf_parts("doc_", "docs")



def _similarity_parts(prefix: str, source: str) -> None:
    """Cosines of all pairs of texts, candidate pools, and the training sample of ``source``."""
    p = prefix
    _part(
        f"{p}cosines",
        (f"{p}weights",),
        f"""
SELECT a.mo_text AS q, b.mo_text AS c, round(sum(a.weight * b.weight), 9) AS similarity
FROM {p}weights a JOIN {p}weights b USING (term) GROUP BY ALL""",
    )
    _part(
        f"{p}all_cosines",
        (f"{p}cosines",),
        f"""
SELECT q.mo_text AS q, c.mo_text AS c, coalesce(similarity, 0) AS similarity
FROM {p}texts q CROSS JOIN {p}texts c LEFT JOIN {p}cosines s ON s.q = q.mo_text AND s.c = c.mo_text""",
    )
    _part(
        f"{p}pool",
        (f"{p}all_cosines",),
        f"""
SELECT q, similarity, s.*,
       CAST(row_number() OVER (PARTITION BY q ORDER BY similarity DESC, dr_no) AS INTEGER) AS pool_rank
FROM {p}all_cosines JOIN {source} s ON s.mo_text = c QUALIFY pool_rank <= {10 * catalog.DEEP_K}""",
    )
    samples = {
        "sampled": evaluation_run.TRAINING_CASES,
        "evaluated": evaluation_run.OFFLINE["eval_cases"],
        "shown": evaluation_run.SERVED["eval_cases"],
    }
    for name, n in samples.items():
        _part(
            f"{p}{name}",
            (source,),
            f"""
SELECT * FROM {source} WHERE crm_cd IS NOT NULL AND area_name IS NOT NULL AND mo_text IS NOT NULL
ORDER BY md5(CAST(dr_no AS VARCHAR) || ':42'), dr_no LIMIT {n}""",
        )


_similarity_parts("", "cases")
_similarity_parts("doc_", "docs")


def _list_part(name: str, k: int, bases: str = "cases", keep: str = "", pool: str = "pool") -> None:
    """Ranked lists of length k: pool, not the base, filter, first k."""
    depth = max(200, 10 * k)
    _part(
        name,
        (pool, bases),
        f"""
SELECT b.dr_no AS q_id, b.datetime AS b_datetime, b.area_name AS b_area, b.crm_cd AS b_crm,
       b.weapon_desc AS b_weapon, b.vict_age AS b_age, b.vict_sex AS b_sex, b.mo_text AS b_text,
       CAST(row_number() OVER (PARTITION BY b.dr_no ORDER BY p.pool_rank) AS INTEGER) AS rank, p.*
FROM {bases} b JOIN {pool} p ON p.q = b.mo_text
WHERE p.pool_rank <= {depth} AND p.dr_no <> b.dr_no {keep} QUALIFY rank <= {k}""",
    )


_list_part("top_list", catalog.TOP_K)
_list_part("served_list", catalog.SERVED_K)
_list_part("area_list", catalog.SERVED_K, keep=f"AND p.area_name = '{catalog.AREA}'")
_list_part("weapon_list", catalog.SERVED_K, keep=f"AND p.weapon_desc = '{catalog.WEAPON}'")
_list_part("area_deep_list", catalog.DEEP_K, keep=f"AND p.area_name = '{catalog.AREA}'")
_list_part("doc_list", catalog.TOP_K, "docs", pool="doc_pool")
for _name, _condition in (("area", f"area_name = '{catalog.AREA}'"), ("weapon", f"weapon_desc = '{catalog.WEAPON}'")):
    _part(
        f"within_{_name}",
        ("all_cosines",),
        f"""
SELECT b.dr_no AS q_id, similarity, p.*,
       CAST(row_number() OVER (PARTITION BY b.dr_no ORDER BY similarity DESC, p.dr_no) AS INTEGER) AS rank
FROM cases b JOIN all_cosines ON q = b.mo_text JOIN (
  SELECT * FROM cases WHERE {_condition} QUALIFY row_number() OVER (PARTITION BY mo_text ORDER BY dr_no) <= {catalog.TOP_K + 1}
) p ON p.mo_text = c
WHERE p.dr_no <> b.dr_no QUALIFY rank <= {catalog.TOP_K}""",
    )
_part(
    "relevant",
    ("cases",),
    """
SELECT b.dr_no, count(c.dr_no) AS relevant FROM cases b LEFT JOIN cases c ON c.dr_no <> b.dr_no
  AND CAST(coalesce(c.crm_cd = b.crm_cd, FALSE) AS INTEGER) + CAST(coalesce(c.area_name = b.area_name, FALSE) AS INTEGER)
    + CAST(coalesce(c.weapon_desc = b.weapon_desc, FALSE) AS INTEGER) + CAST(coalesce(c.mo_text = b.mo_text, FALSE) AS INTEGER) >= 2
GROUP BY b.dr_no""",
)
_part(
    "doc_sided",
    ("docs",),
    f"""
SELECT dr_no, ('0x' || substr(md5(mo_text || ':42'), 1, 8))::BIGINT % 100 >= {linkage.TRAINING_SHARE} AS held FROM docs
WHERE crm_cd IS NOT NULL AND area_name IS NOT NULL AND mo_text IS NOT NULL""",
)
_list_part("training_list", 15, "sampled")
_list_part("doc_training_list", 15, "doc_sampled", pool="doc_pool")
_list_part("doc_evaluated_list", max(evaluation_run.OFFLINE["k_values"]), "doc_evaluated", pool="doc_pool")
_list_part("doc_shown_list", max(evaluation_run.SERVED["k_values"]), "doc_shown", pool="doc_pool")

_SERVED = """q_id, rank, dr_no, strftime(datetime, '%Y-%m-%d') AS datetime, area_name, crm_cd_desc, weapon_desc,
       vict_age, vict_sex, round(similarity, 6) AS similarity, mo_text"""


def _equal(a: str, b: str) -> str:
    return f"CAST(coalesce({a} = {b}, FALSE) AS INTEGER)"


_LABEL = f"""CAST({_equal('crm_cd', 'b_crm')} + {_equal('area_name', 'b_area')} +
       {_equal('weapon_desc', 'b_weapon')} + {_equal('mo_text', 'b_text')} >= 2 AS INTEGER)"""
_DAYS = "abs(floor((epoch_us(datetime) - epoch_us(b_datetime)) / 86400000000))"
_FEATURES = f"""round(similarity, 6) AS similarity,
       {_equal('area_name', 'b_area')} AS area_match,
       {_equal('weapon_desc', 'b_weapon')} AS weapon_match,
       {_equal('crm_cd', 'b_crm')} AS crime_code_match,
       round(exp(-{_DAYS} / 365.0), 6) AS time_decay,
       {_equal('vict_sex', 'b_sex')} AS sex_match,
       abs(coalesce(CAST(vict_age AS DOUBLE), 40.0) - coalesce(CAST(b_age AS DOUBLE), 40.0)) AS age_difference"""



def _metric_parts(prefix: str, lists: str, bases: str, source: str, k_values) -> None:
    """Metrics per base and k of the ranked lists."""
    p = prefix
    ks = ", ".join(f"({k})" for k in k_values)
    _part(f"{p}labels", (lists,), f"SELECT q_id, rank, {_LABEL} AS rel FROM {lists}")
    _part(f"{p}ks", (), f"SELECT * FROM (VALUES {ks}) t(k)")
    _part(
        f"{p}by_k",
        (f"{p}labels", f"{p}ks", bases),
        f"""
SELECT b.dr_no, b.crm_cd, ks.k, rank, rel,
       row_number() OVER (PARTITION BY b.dr_no, ks.k ORDER BY rel DESC, rank) AS ideal_rank
FROM {bases} b CROSS JOIN {p}ks ks LEFT JOIN {p}labels l ON l.q_id = b.dr_no AND l.rank <= ks.k""",
    )
    _part(
        f"{p}per_case",
        (f"{p}by_k",),
        f"""
SELECT dr_no, k, hits / k AS precision,
       CASE WHEN n = 0 OR greatest(0.3 * same_crime, hits) = 0 THEN 0
            ELSE hits / greatest(0.3 * same_crime, hits) END AS recall,
       CASE WHEN hits = 0 THEN 0 ELSE dcg / idcg END AS ndcg
FROM (SELECT dr_no, k, count(rank) AS n, CAST(coalesce(sum(rel), 0) AS DOUBLE) AS hits,
             (SELECT count(*) FROM {source} c WHERE c.crm_cd = o.crm_cd) AS same_crime,
             sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(ideal_rank + 1)) AS idcg
      FROM {p}by_k o GROUP BY dr_no, crm_cd, k)""",
    )
    _part(
        f"{p}scored",
        (f"{p}per_case",),
        f"""
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1
FROM {p}per_case""",
    )


_metric_parts("", "top_list", "cases", "cases", evaluation.K_VALUES)
_metric_parts("doc_", "doc_evaluated_list", "doc_evaluated", "docs", evaluation_run.OFFLINE["k_values"])
_metric_parts("doc_shown_", "doc_shown_list", "doc_shown", "docs", evaluation_run.SERVED["k_values"])


def _means(scored: str) -> str:
    return f"""SELECT k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, round(avg(ndcg), 6) AS ndcg FROM {scored} GROUP BY k"""


def _base_means(scored: str) -> str:
    return f"""SELECT k, round(avg(precision), 6) AS base_precision, round(avg(recall), 6) AS base_recall,
       round(avg(ndcg), 6) AS base_ndcg FROM {scored} GROUP BY k"""


def _top(column: str, n: int | None, source: str = "cases") -> str:
    limit = "" if n is None else f" LIMIT {n}"
    return _with(
        (source,),
        f"""SELECT {column} AS name, count(*) AS count FROM {source} WHERE {column} IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1{limit}""",
    )


_WEAPON = "coalesce(weapon_desc, 'UNKNOWN')"
_SEX = "coalesce(vict_sex, 'Unknown')"
_BINS = "(VALUES (0,'0-17',0,18),(1,'18-29',18,30),(2,'30-44',30,45),(3,'45-59',45,60),(4,'60-79',60,80),(5,'80+',80,120)) b(pos,name,low,high)"
_DAYS_AXIS = "(VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),(5,'Saturday'),(6,'Sunday')) d(pos,name)"
_MONTHS_AXIS = "(VALUES (1,'Jan'),(2,'Feb'),(3,'Mar'),(4,'Apr'),(5,'May'),(6,'Jun'),(7,'Jul'),(8,'Aug'),(9,'Sep'),(10,'Oct'),(11,'Nov'),(12,'Dec')) m(month_num,month)"
_AGES = f"SELECT pos, name, count(vict_age) AS count FROM {_BINS} LEFT JOIN cases ON vict_age >= low AND vict_age < high GROUP BY 1, 2"


def _weekdays(source: str) -> str:
    return f"SELECT pos, name, count(datetime) AS count FROM {_DAYS_AXIS} LEFT JOIN {source} ON isodow(datetime) = pos + 1 GROUP BY 1, 2"


_part(
    "months",
    ("cases",),
    """
SELECT strftime(m, '%Y-%m') AS month, count(datetime) AS count
FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(datetime)) FROM cases),
                                    (SELECT max(datetime) FROM cases), INTERVAL 1 MONTH)) AS m)
LEFT JOIN cases ON date_trunc('month', datetime) = m GROUP BY 1""",
)
_YEARS = range(1995, 2002)


def _ranked_chart(metric: str, column: str, n: int | None) -> str:
    limit = "" if n is None else f" QUALIFY pos < {n}"
    return f"""SELECT '{metric}' AS metric, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS INTEGER) AS pos,
       {column} AS name, count(*) AS count FROM cases GROUP BY {column}{limit}"""


def oracle_sql() -> dict[str, str]:
    raw_all = _with(("raw",), "SELECT * FROM raw")
    cases_all = _with(("cases",), "SELECT * FROM cases")
    n = catalog.RECENT
    newest = "ORDER BY datetime DESC, dr_no LIMIT"
    metric = lambda c: _with(("scored",), f"SELECT dr_no, k, round({c}, 6) AS {c} FROM scored")
    return {
        "scan_raw_cases": raw_all,
        "normalize_headers": raw_all,
        "scan_cases": cases_all,
        "parse_dates": _with(("dated",), "SELECT dr_no, CAST(CAST(occurred AS DATE) AS TIMESTAMP) AS datetime FROM dated"),
        "parse_dates_with_time": _with(("dated",), "SELECT dr_no, occurred AS datetime FROM dated"),
        "build_mo_text": _with(("raw",), f"SELECT dr_no, {_MO_TEXT} AS mo_text FROM raw"),
        "build_mo_text_no_weapon": _with(
            ("raw",),
            "SELECT dr_no, lower(crm_cd_desc) || ' ' || lower(crm_cd_desc) || ' ' || lower(area_name) AS mo_text FROM raw",
        ),
        "replace_sentinel": _with(
            ("raw",),
            f"""SELECT dr_no, CASE WHEN weapon_desc = 'nan' THEN 'unknown' ELSE weapon_desc END AS weapon_desc,
       vict_sex, {_MO_TEXT} AS mo_text FROM raw""",
        ),
        "clean_cases": _with(("prepared",), "SELECT * FROM prepared"),
        "recent_cases": _with(("cases",), f"SELECT * FROM cases {newest} {n}"),
        "daily_latest_cases": _with(("cases",), f"SELECT * FROM cases {newest} {n}"),
        "latest_cases": _with(("timed",), f"SELECT * FROM timed {newest} {catalog.LATEST}"),
        "prepare_cases": _with(("unique_prepared",), "SELECT * FROM unique_prepared"),
        "prepare_recent_cases": _with(("unique_prepared",), f"SELECT * FROM unique_prepared {newest} {n}"),
        "deduplicated_cases": _with(("unique_typed",), "SELECT * FROM unique_typed"),
        "dropped_rows": _with(
            ("raw", "dated"),
            f"""SELECT * FROM (
  SELECT '{prepare.NO_DATE}' AS reason, count(*) AS rows FROM raw WHERE coalesce(trim(date_occ), '') = ''
  UNION ALL SELECT '{prepare.UNREADABLE_DATE}', (SELECT count(date_occ) FROM raw) - (SELECT count(*) FROM dated)
  UNION ALL SELECT '{prepare.REPEATED_ID}', count(*) - count(DISTINCT dr_no) FROM dated) WHERE rows > 0""",
        ),
        "case_detail": _with(
            ("cases",),
            """SELECT dr_no, strftime(datetime, '%Y-%m-%d') AS datetime, area_name, crm_cd, crm_cd_desc, weapon_desc,
       vict_age, vict_sex, mo_text FROM cases WHERE dr_no IN (SELECT l_orderkey FROM lineitem)""",
        ),
        "case_detail_by_lot": _with(
            ("cases",),
            """SELECT dr_no, strftime(datetime, '%Y-%m-%d') AS datetime, area_name, crm_cd, crm_cd_desc, weapon_desc,
       vict_age, vict_sex, mo_text FROM cases WHERE dr_no IN (SELECT l_orderkey FROM lineitem)""",
        ),
        "checked_raw_cases": _with(("raw",), "SELECT * FROM raw WHERE CAST(dr_no AS BIGINT) % 50 NOT IN (3, 7, 11, 13)"),
        "rejected_lines": _with(
            ("raw",),
            f"""SELECT reason, count(*) AS lines FROM (
  SELECT unnest(CASE CAST(dr_no AS BIGINT) % 50 WHEN 3 THEN ['{cases.TOO_FEW}'] WHEN 7 THEN ['{cases.TOO_MANY}'] WHEN 11 THEN ['{cases.OPEN_QUOTE}']
    WHEN 13 THEN ['{cases.OPEN_QUOTE}', '{cases.OPEN_QUOTE}'] ELSE ['accepted'] END) AS reason FROM raw) GROUP BY reason""",
        ),
        "search_ids_indexed": _with(
            ("cases",),
            "SELECT pattern, dr_no FROM cases JOIN (VALUES "
            + ", ".join(f"('{p}')" for p in catalog.ID_PATTERNS)
            + ") p(pattern) ON regexp_matches(CAST(dr_no AS VARCHAR), pattern) QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY dr_no) <= 10",
        ),
        "search_case_ids": _with(
            ("cases",),
            f"SELECT dr_no FROM cases WHERE regexp_matches(CAST(dr_no AS VARCHAR), '{catalog.ID_PATTERN}') ORDER BY dr_no LIMIT 10",
        ),
        "summary_metrics": _with(
            ("cases",),
            """SELECT count(*) AS total_cases, count(DISTINCT area_name) AS distinct_areas,
       count(DISTINCT crm_cd_desc) AS crime_types,
       CAST(coalesce(floor((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 86400000000), 0) AS BIGINT) AS time_span_days,
       strftime(min(datetime), '%Y-%m-%d') AS min_date, strftime(max(datetime), '%Y-%m-%d') AS max_date FROM cases""",
        ),
        "top_areas": _top("area_name", 5),
        "top_areas_10": _top("area_name", 10),
        "top_weapons": _top(_WEAPON, 5),
        "top_weapons_10": _top(_WEAPON, 10),
        "top_crime_types": _top("crm_cd_desc", 10),
        "recent_in_category": _with(
            ("cases",),
            f"""SELECT dr_no, strftime(datetime, '%Y-%m-%d') AS datetime, area_name, weapon_desc, vict_age, vict_sex
FROM cases WHERE crm_cd_desc = '{catalog.CATEGORY}' ORDER BY cases.datetime DESC, dr_no LIMIT 10""",
        ),
        "monthly_trend": _with(("months",), "SELECT * FROM months"),
        "age_groups": _with(("cases",), f"SELECT name, count FROM ({_AGES})"),
        "sex_breakdown": _top(_SEX, None),
        "sex_breakdown_pct": _with(
            ("cases",),
            f"SELECT {_SEX} AS name, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cases GROUP BY 1",
        ),
        "day_of_week": _with(("timed",), f"SELECT name, count FROM ({_weekdays('timed')})"),
        "hour_of_day": _with(
            ("timed",), "SELECT CAST(hour(datetime) AS INTEGER) AS name, count(*) AS count FROM timed GROUP BY 1"
        ),
        "yoy_trend": _with(
            ("cases",),
            "SELECT month, "
            + ", ".join(f'count(*) FILTER (year(datetime) = {y}) AS "{y}"' for y in _YEARS)
            + f" FROM {_MONTHS_AXIS} LEFT JOIN cases ON month(datetime) = month_num GROUP BY month",
        ),
        "yoy_trend_long": _with(
            ("cases",),
            f"""SELECT month_num, month, CAST(y AS INTEGER) AS year, count(datetime) AS count
FROM {_MONTHS_AXIS} CROSS JOIN (SELECT DISTINCT year(datetime) AS y FROM cases WHERE datetime IS NOT NULL)
LEFT JOIN cases ON month(datetime) = month_num AND year(datetime) = y GROUP BY ALL""",
        ),
        "same_crime_counts": _with(
            ("cases",),
            """SELECT dr_no, coalesce(n, 0) AS same_crime_count
FROM cases LEFT JOIN (SELECT crm_cd, count(*) AS n FROM cases GROUP BY 1) USING (crm_cd)""",
        ),
        "analytics_report": _with(
            ("months",),
            f"""SELECT 'monthly_trend' AS metric, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS pos, month AS name, count FROM months
UNION ALL {_ranked_chart("top_areas", "area_name", 10)}
UNION ALL {_ranked_chart("top_weapons", _WEAPON, 10)}
UNION ALL {_ranked_chart("sex_breakdown", _SEX, None)}
UNION ALL SELECT 'age_groups', pos, name, count FROM ({_AGES})
UNION ALL SELECT 'day_of_week', pos, name, count FROM ({_weekdays('cases')})
UNION ALL SELECT 'hour_of_day', CAST(hour(datetime) AS INTEGER), CAST(hour(datetime) AS VARCHAR), count(*) FROM cases GROUP BY ALL
UNION ALL SELECT 'yoy_trend', CAST((dense_rank() OVER (ORDER BY y) - 1) * 12 + month_num - 1 AS INTEGER), month || ' ' || y, count(datetime)
FROM {_MONTHS_AXIS} CROSS JOIN (SELECT DISTINCT year(datetime) AS y FROM cases WHERE datetime IS NOT NULL)
LEFT JOIN cases ON month(datetime) = month_num AND year(datetime) = y GROUP BY y, month_num, month""",
        ),
        "daily_analytics_report": _with(
            ("months",),
            f"""SELECT 'monthly_trend' AS metric, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS pos, month AS name, count FROM months
UNION ALL {_ranked_chart("top_areas", "area_name", 10)}
UNION ALL {_ranked_chart("top_weapons", _WEAPON, 10)}
UNION ALL {_ranked_chart("sex_breakdown", _SEX, None)}
UNION ALL SELECT 'age_groups', pos, name, count FROM ({_AGES})
UNION ALL SELECT 'day_of_week', pos, name, count FROM ({_weekdays('cases')})
UNION ALL SELECT 'hour_of_day', CAST(hour(datetime) AS INTEGER), CAST(hour(datetime) AS VARCHAR), count(*) FROM cases GROUP BY ALL
UNION ALL SELECT 'yoy_trend', CAST((dense_rank() OVER (ORDER BY y) - 1) * 12 + month_num - 1 AS INTEGER), month || ' ' || y, count(datetime)
FROM {_MONTHS_AXIS} CROSS JOIN (SELECT DISTINCT year(datetime) AS y FROM cases WHERE datetime IS NOT NULL)
LEFT JOIN cases ON month(datetime) = month_num AND year(datetime) = y GROUP BY y, month_num, month""",
        ),
        "daily_summary": _with(
            ("cases",),
            """SELECT count(*) AS total_cases, count(DISTINCT area_name) AS distinct_areas, count(DISTINCT crm_cd_desc) AS crime_types,
       TRUE AS ids_close, strftime(min(datetime), '%Y-%m-%d') AS min_date, strftime(max(datetime), '%Y-%m-%d') AS max_date FROM cases""",
        ),
        "metrics_report": _with(
            ("cases",),
            f"""SELECT 'summary' AS metric, 0 AS pos, 'total_cases' AS name, count(*) AS count FROM cases
UNION ALL SELECT 'summary', 1, 'distinct_areas', count(DISTINCT area_name) FROM cases
UNION ALL SELECT 'summary', 2, 'crime_types', count(DISTINCT crm_cd_desc) FROM cases
UNION ALL SELECT 'summary', 3, 'time_span_days',
  CAST(coalesce(floor((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 86400000000), 0) AS BIGINT) FROM cases
UNION ALL SELECT 'summary', 4, 'min_date ' || strftime(min(datetime), '%Y-%m-%d'), NULL FROM cases
UNION ALL SELECT 'summary', 5, 'max_date ' || strftime(max(datetime), '%Y-%m-%d'), NULL FROM cases
UNION ALL {_ranked_chart("top_areas", "area_name", 5)}
UNION ALL {_ranked_chart("top_weapons", _WEAPON, 5)}""",
        ),
        "tokenize_text": _with(
            ("docs",),
            f"""SELECT dr_no, term FROM (
  SELECT dr_no, unnest(regexp_extract_all(lower(mo_text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docs)
WHERE term NOT IN ({_STOP})""",
        ),
        "term_frequency": _with(("doc_tf",), "SELECT dr_no, term, tf FROM docs JOIN doc_tf USING (mo_text)"),
        "idf": _with(("doc_idf",), "SELECT term, df, round(idf, 6) AS idf FROM doc_idf"),
        "tfidf_weights": _with(
            ("doc_weights",), "SELECT dr_no, term, round(weight, 6) AS weight FROM docs JOIN doc_weights USING (mo_text)"
        ),
        "appended_tfidf_weights": _with(
            ("doc_weights",), "SELECT dr_no, term, round(weight, 6) AS weight FROM docs JOIN doc_weights USING (mo_text)"
        ),
        "case_tfidf_weights": _with(
            ("weights",), "SELECT dr_no, term, round(weight, 6) AS weight FROM cases JOIN weights USING (mo_text)"
        ),
        "tfidf_stats": _with(
            ("doc_tf",),
            """SELECT (SELECT count(*) FROM docs) AS n_rows, count(DISTINCT term) AS vocabulary,
       CAST(sum(n_rows) AS BIGINT) AS stored_elements FROM doc_tf""",
        ),
        "tfidf_roundtrip": _with(("weights",), "SELECT mo_text, term, round(weight, 6) AS weight FROM weights"),
        "cosine_similarity": _with(
            ("all_cosines",),
            """SELECT b.dr_no AS q_id, c.dr_no, round(similarity, 6) AS similarity
FROM (SELECT * FROM cases ORDER BY datetime DESC, dr_no LIMIT 1) b
JOIN all_cosines s ON s.q = b.mo_text JOIN cases c ON c.mo_text = s.c""",
        ),
        "candidate_pool": _with(
            ("pool",), "SELECT q AS mo_text, pool_rank, dr_no, round(similarity, 6) AS similarity FROM pool WHERE pool_rank <= 200"
        ),
        "similar_cases": _with(("top_list",), f"SELECT {_SERVED} FROM top_list"),
        "similar_by_area": _with(("area_list",), f"SELECT {_SERVED} FROM area_list"),
        "similar_by_area_deep": _with(("area_deep_list",), f"SELECT {_SERVED} FROM area_deep_list"),
        "similar_by_weapon": _with(("weapon_list",), f"SELECT {_SERVED} FROM weapon_list"),
        "similar_documents": _with(("doc_list",), "SELECT q_id, dr_no, rank, round(similarity, 6) AS similarity FROM doc_list"),
        "similar_within_area": _with(("within_area",), f"SELECT {_SERVED} FROM within_area"),
        "similar_within_weapon": _with(("within_weapon",), f"SELECT {_SERVED} FROM within_weapon"),
        "relevant_counts": _with(("relevant",), "SELECT dr_no, relevant FROM relevant"),
        "true_recall_at_k": _with(
            ("relevant", "labels", "ks"),
            """SELECT r.dr_no, ks.k, round(CASE WHEN relevant = 0 THEN 0 ELSE coalesce(sum(rel), 0) / relevant END, 6) AS recall
FROM relevant r CROSS JOIN ks LEFT JOIN labels l ON l.q_id = r.dr_no AND l.rank <= ks.k GROUP BY r.dr_no, ks.k, relevant""",
        ),
        "held_out_samples": _with(
            ("doc_sided",),
            f"""SELECT dr_no, CASE WHEN held THEN 'evaluation' ELSE 'training' END AS side FROM doc_sided
QUALIFY row_number() OVER (PARTITION BY held ORDER BY md5(CAST(dr_no AS VARCHAR) || ':42'), dr_no)
  <= CASE WHEN held THEN {evaluation_run.OFFLINE["eval_cases"]} ELSE {evaluation_run.TRAINING_CASES} END""",
        ),
        "pair_features": _with(("served_list",), f"SELECT q_id, dr_no, {_FEATURES} FROM served_list"),
        "relevance_labels": _with(("served_list",), f"SELECT q_id, dr_no, {_LABEL} AS label FROM served_list"),
        "training_sample": _with(("sampled",), "SELECT dr_no FROM sampled"),
        "training_pairs": _with(
            ("training_list",), f"SELECT q_id, dr_no, {_FEATURES}, {_LABEL} AS label FROM training_list"
        ),
        "training_label_rate": _with(
            ("training_list",),
            f"""SELECT count(*) AS pairs, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS positive_rate
FROM (SELECT {_LABEL} AS label FROM training_list)""",
        ),
        "precision_at_k": metric("precision"),
        "recall_at_k": metric("recall"),
        "f1_at_k": metric("f1"),
        "ndcg_at_k": metric("ndcg"),
        "map_at_k": _with(
            ("labels",),
            """SELECT round(avg(ap), 6) AS map FROM (
  SELECT b.dr_no, coalesce(sum(rel * found / rank) / nullif(sum(rel), 0), 0) AS ap
  FROM cases b LEFT JOIN (
    SELECT *, sum(rel) OVER (PARTITION BY q_id ORDER BY rank) AS found FROM labels) l ON l.q_id = b.dr_no
  GROUP BY b.dr_no)""",
        ),
        "evaluate_similarity": _with(("scored",), _means("scored")),
        "evaluate_sample": _with(("doc_scored",), _means("doc_scored")),
        "train_ensemble_checked": _with(
            ("doc_training_list",), f"SELECT q_id, dr_no, {_LABEL} AS label, TRUE AS sound FROM doc_training_list"
        ),
        "score_pairs_checked": _with(("served_list",), "SELECT q_id, dr_no, TRUE AS sound FROM served_list"),
        "feature_importances_checked": "SELECT '" + ",".join(sorted(FEATURES)) + "' AS features, 1.0::DOUBLE AS rf, 1.0::DOUBLE AS gb, 1.0::DOUBLE AS avg",
        "model_roundtrip_checked": _with(("doc_training_list",), "SELECT count(*) AS pairs, 0::BIGINT AS changed FROM doc_training_list"),
        "ranked_cases_checked": _with(
            ("served_list",),
            "SELECT q_id, count(*) AS hits, max(rank) AS last_rank, count(*) FILTER (dr_no = q_id) AS own, count(*) AS explained FROM served_list GROUP BY q_id",
        ),
        "compare_models_checked": _with(("doc_scored",), _base_means("doc_scored")),
        "compare_models_served_checked": _with(("doc_shown_scored",), _base_means("doc_shown_scored")),
        "document_training_pairs": _with(
            ("doc_training_list",), f"SELECT q_id, dr_no, {_FEATURES}, {_LABEL} AS label FROM doc_training_list"
        ),
    }
