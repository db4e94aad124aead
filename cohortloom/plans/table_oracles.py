"""DuckDB SQL for the queries of ``table_queries``, written from the query meaning, not from the Spark plan."""

from __future__ import annotations

TOKEN = r"[0-9]+(?:\.[0-9]+)*[\p{L}\p{N}]*|[\p{L}\p{N}]+"

INDEX = """
    SELECT c.c_custkey, o.o_orderkey, l.l_linenumber,
           dense_rank() OVER (PARTITION BY c.c_custkey, o.o_orderkey ORDER BY l.l_linenumber NULLS LAST) AS ind
    FROM customer c
    LEFT JOIN (SELECT * FROM orders WHERE {where}) o ON c.c_custkey = o.o_custkey
    LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
"""

ORDER_FLAGS = """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END AS returned,
           CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) THEN 1 ELSE 0 END AS bulky,
           CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09) THEN 1 ELSE 0 END AS discounted
    FROM orders
"""

COHORT = f"""
    SELECT i.*, f.returned, f.bulky, o.o_orderstatus, o.o_orderdate, o.o_totalprice
    FROM ({ORDER_FLAGS}) f
    LEFT JOIN ({INDEX.format(where="true")}) i ON i.o_orderkey = f.o_orderkey
    LEFT JOIN orders o ON o.o_orderkey = i.o_orderkey
    WHERE f.returned = 1 AND i.ind = 1
"""

RANKED_EVENTS = """
    SELECT *,
           row_number() OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC) AS rn_first,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS rn_last,
           CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS purchase
    FROM events
"""

WINDOWS = """
    SELECT user_id, min(ts) AS start_ts, min(ts) + INTERVAL 7 DAY AS end_ts FROM events GROUP BY user_id
"""

CRITERIA = [
    ("finished", "o_orderstatus = 'F'"),
    ("large", "o_totalprice > 100000"),
    ("urgent", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("from 1997", "o_orderdate >= TIMESTAMP '1997-01-01'"),
]


def attrition_sql(source: str, key: str, criteria: list[tuple[str, str]], cumulative: bool = True) -> str:
    parts = []
    for i, (label, test) in enumerate(criteria):
        tests = [t for _, t in criteria[: i + 1]] if cumulative else [test]
        where = " AND ".join(f"({t})" for t in tests)
        parts.append(
            f"SELECT {i + 1} AS step, '{label}' AS label, count(*) AS n_rows, count(DISTINCT {key}) AS n_keys "
            f"FROM ({source}) WHERE {where}"
        )
    return " UNION ALL ".join(parts)


def _values(rows: list[tuple]) -> str:
    def text(value: object) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    return "(VALUES " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows) + ")"


def hits_ctes(docs: str, phrases: list[str], slop: int) -> str:
    """CTE ``hits(phrase, doc_id, windows, spread, score)`` over ``docs(doc_id, text)``, by definition.

    A window start is the offset of any entry; its width is the smallest e at which [start, start + e] holds every
    term, with as many positions of a token as the phrase repeats it.
    """
    score = "0.0::DOUBLE" + "".join(
        f" + count(*) FILTER (width = {e})::DOUBLE / {1 + e}.0::DOUBLE" for e in range(slop + 1)
    )
    return f"""
    phrase_list AS (SELECT DISTINCT phrase FROM {_values([(p,) for p in phrases])} v(phrase)),
    phrase_toks AS (
        SELECT phrase, regexp_extract_all(lower(phrase), '{TOKEN}') AS toks FROM phrase_list),
    terms AS (
        SELECT phrase, unnest(toks) AS tok, unnest(range(len(toks))) AS q, len(toks) AS n FROM phrase_toks),
    needed AS (SELECT phrase, tok, count(*) AS k, any_value(n) AS n FROM terms GROUP BY phrase, tok),
    n_toks AS (SELECT phrase, count(*) AS m FROM needed GROUP BY phrase),
    doc_toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS toks FROM ({docs})),
    places AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS p FROM doc_toks),
    entries AS (
        SELECT doc_id, phrase, tok, q, p, p - q AS d FROM places JOIN terms USING (tok)),
    whole AS (
        SELECT doc_id, phrase FROM entries JOIN n_toks USING (phrase)
        GROUP BY doc_id, phrase, m HAVING count(DISTINCT tok) = m),
    kept AS (SELECT entries.* FROM entries JOIN whole USING (doc_id, phrase)),
    starts AS (SELECT DISTINCT doc_id, phrase, d AS w FROM kept),
    seen AS (
        SELECT s.doc_id, s.phrase, s.w, e.e, k.tok, count(DISTINCT k.q) AS nq, count(DISTINCT k.p) AS np
        FROM starts s JOIN kept k ON k.doc_id = s.doc_id AND k.phrase = s.phrase AND k.d BETWEEN s.w AND s.w + {slop}
        JOIN (SELECT unnest(range({slop + 1})) AS e) e ON k.d <= s.w + e.e
        GROUP BY s.doc_id, s.phrase, s.w, e.e, k.tok),
    fitted AS (
        SELECT seen.doc_id, seen.phrase, seen.w, seen.e
        FROM seen JOIN needed USING (phrase, tok) JOIN n_toks USING (phrase)
        WHERE seen.nq = needed.k AND seen.np >= needed.k
        GROUP BY seen.doc_id, seen.phrase, seen.w, seen.e, n_toks.m HAVING count(*) = n_toks.m),
    widths AS (SELECT doc_id, phrase, w, min(e) AS width FROM fitted GROUP BY doc_id, phrase, w),
    hits AS (
        SELECT phrase, doc_id, count(*) AS windows, min(width)::INTEGER AS spread, {score} AS score
        FROM widths GROUP BY phrase, doc_id)
    """


def catalogue_cte(rows: list[tuple[str, str, str]]) -> str:
    numbered = [(i, *row) for i, row in enumerate(rows)]
    return f"catalogue AS (SELECT * FROM {_values(numbered)} v(position, category, level, phrase))"


def summary_cte(seed: int) -> str:
    return f"""
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, doc_id) AS rnk,
               row_number() OVER (PARTITION BY phrase ORDER BY md5(doc_id::VARCHAR || ':{seed}'), doc_id) AS draw
        FROM hits),
    summary AS (
        SELECT phrase, count(*) AS n_docs,
               max(CASE WHEN rnk = 1 THEN doc_id END) AS first_doc,
               max(CASE WHEN draw = 1 THEN doc_id END) AS random_doc,
               arg_max(doc_id, rnk) AS last_doc
        FROM ranked GROUP BY phrase),
    stats AS (
        SELECT c.position, c.category, c.level, c.phrase, coalesce(n_docs, 0) AS n_docs,
               coalesce(first_doc, 0) AS first_doc, coalesce(random_doc, 0) AS random_doc,
               coalesce(last_doc, 0) AS last_doc
        FROM catalogue c LEFT JOIN summary s ON s.phrase = c.phrase)
    """


def cohort_ids_cte(cohorts: dict[str, list[str]]) -> str:
    pairs = [(name, level) for name, levels in cohorts.items() for level in levels]
    return f"""
    cohort_levels AS (SELECT * FROM {_values(pairs)} v(cohort, level)),
    cohort_ids AS (
        SELECT DISTINCT cohort, doc_id FROM hits JOIN catalogue USING (phrase) JOIN cohort_levels USING (level))
    """


def report_sql(titles: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{key}' THEN '{title}'" for key, title in titles.items())
    return f"""
    SELECT min(position) * 100 AS ord, CASE category {cases} ELSE category END AS line FROM catalogue GROUP BY category
    UNION ALL SELECT min(position) * 100 + 1, '' FROM catalogue GROUP BY category
    UNION ALL SELECT min(position) * 100 + 10, repeat('*', 25) FROM catalogue GROUP BY category, level
    UNION ALL SELECT min(position) * 100 + 11, upper(level) FROM catalogue GROUP BY category, level
    UNION ALL SELECT min(position) * 100 + 12, repeat('*', 25) FROM catalogue GROUP BY category, level
    UNION ALL SELECT min(position) * 100 + 13, '' FROM catalogue GROUP BY category, level
    UNION ALL SELECT position * 100 + 20, phrase FROM stats
    UNION ALL SELECT position * 100 + 21, 'Number of Documents ' || n_docs FROM stats
    UNION ALL SELECT position * 100 + 22, 'First ' || first_doc FROM stats
    UNION ALL SELECT position * 100 + 23, 'Random ' || random_doc FROM stats
    UNION ALL SELECT position * 100 + 24, 'Last ' || last_doc FROM stats
    UNION ALL SELECT position * 100 + 25, '' FROM stats
    UNION ALL SELECT max(position) * 100 + 30, '' FROM catalogue GROUP BY category
    UNION ALL SELECT max(position) * 100 + 31, repeat('*', 100) FROM catalogue GROUP BY category
    """


def json_sql(part_size: int) -> str:
    return f"""
    , parts AS (
        SELECT phrase, ((rnk - 1) // {part_size})::INTEGER AS part,
               '[' || string_agg(doc_id::VARCHAR, ',' ORDER BY rnk) || ']' AS ids
        FROM ranked GROUP BY 1, 2)
    SELECT category, level, c.phrase, coalesce(part, 0) AS part, coalesce(ids, '[]') AS ids
    FROM catalogue c LEFT JOIN parts p ON p.phrase = c.phrase
    """


def _sample(seed: int, table: str, key: str, columns: str, n: int) -> str:
    return f"SELECT {columns} FROM {table} ORDER BY md5({key}::VARCHAR || ':{seed}'), {key} LIMIT {n}"


def oracles() -> dict[str, str]:
    from . import table_queries as t

    documents = "SELECT doc_id, text FROM documents"
    hits = hits_ctes(documents, t.PHRASES, t.SLOP)
    catalogue = catalogue_cte(t.CATALOGUE)
    summary = summary_cte(t.SEED)
    licence = "regexp_matches(text, 'licen[cs]e|copyright', 'i')"
    label_rows = "SELECT lang || ' ' || source AS label FROM documents WHERE contains(lower(lang || ' ' || source), 'src1')"
    label_counts = f"SELECT label, count(*) AS n FROM ({label_rows}) GROUP BY label"
    price = "round_even(l_extendedprice, 0)"
    sources = [
        "l_returnflag = 'A' AND l_quantity > 24.8",
        "l_linestatus = 'O' AND l_returnflag <> 'N' AND l_discount > 0.05",
        "l_extendedprice > 1000 AND l_extendedprice < 20000 AND l_tax > 0.04",
    ]
    sums = [
        f"SELECT l_suppkey, l_shipdate, sum({price}) AS total FROM lineitem WHERE {test} GROUP BY l_suppkey, l_shipdate"
        for test in sources
    ]
    rule_flags = f"({ORDER_FLAGS})"
    sql = {
        "q01_encounter_index": INDEX.format(where="o_orderstatus = 'F'"),
        "q01_point_lookup": """
            SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey = 7
            ORDER BY o_orderdate, o_orderkey LIMIT 1""",
        "q01_table_shape": "SELECT count(*) AS n_rows, 5::INTEGER AS n_columns FROM documents",
        "q02_age_flag": """
            SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate,
                   extract(year FROM age(l_shipdate, o_orderdate)) AS age,
                   CASE WHEN extract(year FROM age(l_shipdate, o_orderdate)) < 2 THEN 0 ELSE 1 END AS age_flag
            FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
        "q03_prefix_flags": """
            SELECT p_partkey, p_brand, p_type,
                   CASE WHEN substring(p_brand, 1, 7) IN ('Brand#1') THEN 1
                        WHEN substring(p_brand, 1, 8) IN ('Brand#23', 'Brand#24') THEN 1 ELSE 0 END AS brand_flag,
                   CASE WHEN p_type = 'ECONOMY' OR p_type = 'PROMO' THEN 1 ELSE 0 END AS type_flag
            FROM part""",
        "q04_existence_flags": f"SELECT o_orderkey, o_custkey, returned, bulky FROM {rule_flags}",
        "q05_flag_cascade": f"""
            SELECT *, CASE WHEN bulky = 1 THEN 1 WHEN returned = 1 AND discounted = 1 THEN 2
                           WHEN returned = 1 THEN 3 ELSE 0 END AS rule
            FROM {rule_flags}""",
        "q06_update_from": """
            SELECT o.*, CASE WHEN EXISTS (
                SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45)
                THEN 1 ELSE 0 END AS flagged
            FROM orders o""",
        "q07_last_wins_class": """
            SELECT o_orderkey,
                   CASE WHEN bool_or(l_returnflag = 'R') THEN 'RETURNED' WHEN bool_or(l_returnflag = 'N') THEN 'NONE'
                        WHEN bool_or(l_returnflag = 'A') THEN 'ACCEPTED' END AS line_class
            FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
        "q08_elapsed_hours": """
            SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate,
                   extract(day FROM l_shipdate - o_orderdate) * 24 + extract(hour FROM l_shipdate - o_orderdate) AS hours
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
        "q08_group_counts": """
            SELECT extract(day FROM l_shipdate - o_orderdate) * 24 + extract(hour FROM l_shipdate - o_orderdate) AS hours,
                   count(*) AS n
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
        "q09_cohort_build": COHORT,
        "q10_first_last_status": f"""
            SELECT user_id,
                   max(CASE WHEN rn_first = 1 THEN error END) AS error_first,
                   max(CASE WHEN rn_first = 1 THEN purchase END) AS purchase_first,
                   max(CASE WHEN rn_last = 1 THEN error END) AS error_last,
                   max(CASE WHEN rn_last = 1 THEN purchase END) AS purchase_last,
                   max(error) AS error, max(purchase) AS purchase,
                   min(CASE WHEN error = 1 THEN ts END) AS first_error,
                   min(CASE WHEN purchase = 1 THEN ts END) AS first_purchase
            FROM ({RANKED_EVENTS}) GROUP BY user_id""",
        "q11_interval_join": f"""
            SELECT w.user_id, start_ts, end_ts, count(e.ts) AS n_errors, min(e.ts) AS first_error
            FROM ({WINDOWS}) w
            LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e
                ON e.user_id = w.user_id AND e.ts BETWEEN start_ts AND end_ts
            GROUP BY w.user_id, start_ts, end_ts""",
        "q11_interval_rows": f"""
            SELECT w.user_id, start_ts, end_ts, e.event_id, e.ts
            FROM (SELECT user_id, end_ts - INTERVAL 12 HOUR AS start_ts, end_ts FROM ({WINDOWS})) w
            LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e
                ON e.user_id = w.user_id AND e.ts BETWEEN start_ts AND end_ts""",
        "q66_sweep_sums": """
            WITH days AS (
                SELECT l_linestatus AS status, l_shipdate AS ts, count(*) AS n, sum(floor(l_quantity)) AS q
                FROM lineitem GROUP BY ALL),
            run AS (
                SELECT status, ts, sum(n) OVER w AS n, sum(q) OVER w AS q
                FROM days WINDOW w AS (PARTITION BY status ORDER BY ts)),
            spans AS (
                SELECT o_orderkey, years, o_orderstatus AS status, o_orderdate AS s, o_orderdate + to_years(years) AS e
                FROM orders CROSS JOIN (VALUES (1), (100)) v (years)),
            met AS (
                SELECT o_orderkey, years, coalesce(hi.n, 0) - coalesce(lo.n, 0) AS n,
                       coalesce(hi.q, 0) - coalesce(lo.q, 0) AS q, nxt.ts AS first_ts, hi.ts AS last_ts
                FROM spans p
                ASOF LEFT JOIN run hi ON p.status = hi.status AND p.e >= hi.ts
                ASOF LEFT JOIN run lo ON p.status = lo.status AND p.s > lo.ts
                ASOF LEFT JOIN run nxt ON p.status = nxt.status AND p.s <= nxt.ts)
            SELECT o_orderkey, years, n::BIGINT AS n_lines, CASE WHEN n > 0 THEN q::BIGINT END AS quantity,
                   CASE WHEN n > 0 THEN first_ts END AS first_ship, CASE WHEN n > 0 THEN last_ts END AS last_ship
            FROM met""",
        "q12_text_evidence": """
            SELECT source, lang,
                   max(CASE WHEN regexp_matches(text, '[^E]rea') THEN 1 ELSE 0 END) AS has_rea,
                   max(CASE WHEN regexp_matches(lower(text), 'of.the', 's') THEN 1 ELSE 0 END) AS has_of_the
            FROM documents WHERE lower(text) LIKE '%the%' GROUP BY source, lang""",
        "q13_code_status": f"""
            SELECT w.user_id,
                   max(CASE WHEN rn_first = 1 THEN t.error END) AS error_first,
                   max(CASE WHEN rn_last = 1 THEN t.error END) AS error_last,
                   max(t.error) AS error,
                   min(CASE WHEN t.error = 1 THEN t.ts END) AS first_error,
                   max(CASE WHEN d.noted = 1 THEN 1 ELSE 0 END) AS noted,
                   min(CASE WHEN t.error = 1 THEN p.ts END) AS window_purchase
            FROM ({WINDOWS}) w
            LEFT JOIN ({RANKED_EVENTS}) t ON t.user_id = w.user_id
            LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') p
                ON p.user_id = w.user_id AND p.ts BETWEEN w.start_ts AND w.end_ts
            LEFT JOIN (
                SELECT doc_id % 150 AS user_id,
                       max(CASE WHEN regexp_matches(text, '[Ll]icen[cs]e') THEN 1 ELSE 0 END) AS noted
                FROM documents GROUP BY 1) d ON d.user_id = w.user_id
            GROUP BY w.user_id""",
        "q14_dose_normalise": """
            SELECT * FROM (
                SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
                       round_even(CASE WHEN l_returnflag = 'A' THEN l_quantity * 1000.0::DOUBLE
                                       WHEN l_returnflag = 'N' THEN l_quantity END, 0) AS amount
                FROM lineitem
                WHERE (l_linestatus = 'O' AND l_quantity > 24.8) OR (l_linestatus = 'F' AND l_discount > 0.05))
            WHERE amount > 0""",
        "q15_bolus_union": " UNION ".join(sums[:2]),
        "q15_bolus_union_three": " UNION ".join(sums),
        "q16_attrition": attrition_sql("SELECT * FROM orders", "o_custkey", CRITERIA),
        "q16_separate_counts": attrition_sql("SELECT * FROM orders", "o_custkey", CRITERIA, cumulative=False),
        "q17_keyword_cohort": f"SELECT doc_id, lang, source FROM documents WHERE {licence}",
        "q18_frequency": label_counts,
        "q18_frequency_lines": f"SELECT format('{{:<65s}} ==> {{:>10d}}', label, n) AS line FROM ({label_counts})",
        "q18_frequency_total": f"SELECT count(*)::BIGINT AS total FROM ({label_rows})",
        "q19_flagship": attrition_sql(
            f"""
            SELECT c.*, CASE WHEN bulky = 1 OR EXISTS (
                SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey
                WHERE l_orderkey = c.o_orderkey AND (
                    substring(p_brand, 1, 7) = 'Brand#1' OR substring(p_brand, 1, 8) IN ('Brand#23', 'Brand#24')))
                THEN 1 ELSE 0 END AS rule
            FROM ({COHORT}) c""",
            "c_custkey",
            [
                ("returned", "returned = 1"),
                ("rule", "rule = 1"),
                ("finished", "o_orderstatus = 'F'"),
                ("large", "o_totalprice > 100000"),
            ],
        ),
        "q20_overlap": f"""
            WITH {hits_ctes(documents, ["of the"], t.SLOP)},
            a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
            b AS (SELECT DISTINCT doc_id FROM hits),
            c AS (SELECT DISTINCT doc_id FROM documents WHERE {licence})
            SELECT (SELECT count(*) FROM a) AS n_quality, (SELECT count(*) FROM b) AS n_phrase,
                   (SELECT count(*) FROM c) AS n_licence,
                   (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_quality_and_phrase,
                   (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM c)) AS n_quality_and_licence,
                   (SELECT count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM c)) AS n_phrase_and_licence,
                   (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c)) AS n_union""",
        "q20_union": f"""
            SELECT doc_id AS id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE {licence}""",
        "q20_intersection": f"""
            SELECT doc_id AS id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE {licence}""",
        "q21_semi_join": """
            SELECT doc_id, lang, source, n_chars FROM documents
            WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "q22_seeded_sample": " UNION ALL ".join(
            f"SELECT * FROM ({_sample(seed, 'documents', 'doc_id', f'doc_id, lang, {seed} AS seed', 5)})"
            for seed in t.SEEDS
        ),
        "q22_sample_per_group": f"""
            SELECT doc_id, lang FROM (
                SELECT doc_id, lang, row_number() OVER (
                    PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':{t.SEED}'), doc_id) AS n FROM documents)
            WHERE n <= 3""",
        "q22_one_sample": _sample(t.SEED, "orders", "o_orderkey", "o_orderkey, o_custkey", 20),
        "q23_tokens": f"""
            SELECT lang, count(*) AS n_tokens, max(p)::INTEGER AS last_position, max(tok) AS last_token FROM (
                SELECT lang, unnest(toks) AS tok, unnest(range(len(toks))) AS p FROM (
                    SELECT lang, regexp_extract_all(lower(text), '{TOKEN}') AS toks FROM documents))
            GROUP BY lang""",
        "q24_phrase_search": f"WITH {hits} SELECT * FROM hits",
        "q25_severity_cohorts": f"""
            WITH {hits}, {catalogue}, {cohort_ids_cte(t.COHORTS)}
            SELECT cohort, count(*) AS n_docs FROM cohort_ids GROUP BY cohort""",
        "q25_severity_rows": f"""
            WITH {hits}, {catalogue}, {cohort_ids_cte(t.COHORTS)}
            SELECT cohort, doc_id, lang, source FROM cohort_ids JOIN documents USING (doc_id)""",
        "q26_topk_hits": f"""
            WITH {hits}, {catalogue}, {summary}
            SELECT phrase, rnk::INTEGER AS rank, doc_id, score FROM ranked WHERE rnk <= 10""",
        "q26_peek_hits": f"""
            WITH {hits}, {catalogue}, {summary}
            SELECT r.phrase, rnk::INTEGER AS rank, doc_id FROM ranked r JOIN summary USING (phrase)
            WHERE rnk = 11 OR rnk = n_docs""",
        "q27_hit_summary": f"WITH {hits}, {catalogue}, {summary} SELECT * FROM summary",
        "q27_phrase_stats": f"WITH {hits}, {catalogue}, {summary} SELECT * FROM stats",
        "q27_report_lines": f"WITH {hits}, {catalogue}, {summary} {report_sql(t.TITLES)}",
        "q28_phrase_json": f"WITH {hits}, {catalogue}, {summary} {json_sql(t.PART)}",
        "q29_sink_round_trip": """
            SELECT 'csv' AS sink, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, max(doc_id) AS last_id,
                   sum(length(lang))::BIGINT AS n_chars FROM documents
            UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id), max(doc_id), sum(length(text))::BIGINT
            FROM documents
            UNION ALL SELECT 'table', count(*), count(DISTINCT doc_id), max(doc_id), sum(length(text))::BIGINT
            FROM documents""",
        "q29_row_ordinal": """
            SELECT * FROM (
                SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders)
            WHERE o_orderstatus = 'F'""",
        "q29_exported_texts": """
            SELECT unnest(['files', 'parquet']) AS sink, count(*) AS n_rows, count(DISTINCT item_id) AS n_ids,
                   sum(length(text))::BIGINT AS n_chars FROM benchmark""",
        "q29_path_ids": "SELECT doc_id, doc_id AS path_id FROM documents",
    }
    # The sweep answers the questions of the interval joins.
    return sql | {"q66_sweep_counts": sql["q11_interval_join"], "q66_sweep_rows": sql["q11_interval_rows"]}
