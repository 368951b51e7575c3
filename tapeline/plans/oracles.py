"""The same questions in SQL, written directly on the given tables."""

from __future__ import annotations

FILLS = """fills AS (
  SELECT event_id AS off, 'EXE' || event_id AS exec_id, 'ORD' || (event_id // 4) AS order_id,
    'M' || (user_id % 5) AS member, CASE WHEN user_id % 2 = 0 THEN 'A1' ELSE 'P1' END AS account,
    event_type AS series,
    CASE WHEN (event_id * 7919) % 100 < (CASE user_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 72
      WHEN 2 THEN 25 WHEN 3 THEN 50 ELSE 22 END) THEN 'BUY' ELSE 'SELL' END AS side,
    CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS qty,
    CAST(value AS DECIMAL(18,2)) AS price, ts, user_id
  FROM events)"""

POSITIONS = FILLS + """, positions AS (
  SELECT off, member || '|' || account || '|' || series AS position_key, member, account, series,
    user_id, ts + INTERVAL 60 SECOND AS as_of_time,
    CAST(SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) OVER (
      PARTITION BY member, account, series ORDER BY off
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS net
  FROM fills)"""

CURRENT = POSITIONS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY member, account, series ORDER BY off DESC) AS rn
  FROM positions), current_state AS (SELECT * FROM ranked WHERE rn = 1)"""

REPORTS = FILLS + """, numbered AS (
  SELECT *, unnest(CASE WHEN off % 20 < 3 THEN [0, 1, 2, 3] ELSE [0, 1] END) AS i FROM fills),
 acted AS (SELECT *, CASE WHEN i < 2 THEN 'NEWT' WHEN off % 20 = 0 THEN 'EROR'
    WHEN off % 20 = 1 THEN 'TERM' ELSE 'MODI' END AS action FROM numbered),
 reports AS (
  SELECT off * 4 + i AS roff, 'RPT' || off || '-' || i AS report_id, 'UTI' || off AS uti,
    CASE WHEN i % 2 = 0 THEN 'LEI-' || member ELSE 'CLIENT' || (user_id % 8) END AS cp1,
    CASE WHEN i % 2 = 0 THEN 'CLIENT' || (user_id % 8) ELSE 'LEI-' || member END AS cp2,
    exec_id, action,
    CASE WHEN action <> 'EROR' THEN CAST(price * qty AS DECIMAL(18,2)) END AS notional,
    CASE user_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency,
    ts + CASE WHEN i < 2 THEN INTERVAL 5 MINUTE ELSE INTERVAL 65 MINUTE END AS rts
  FROM acted)"""

LAST_ACTION = REPORTS + """, last_action AS (
  SELECT uti, action, rts, roff FROM (
    SELECT *, row_number() OVER (PARTITION BY uti ORDER BY rts DESC, roff DESC) AS rn FROM reports)
  WHERE rn = 1), live AS (SELECT uti FROM last_action WHERE action NOT IN ('EROR', 'TERM'))"""

SIDES = """, sides AS (
  SELECT cp1 AS party, * FROM reports UNION ALL SELECT cp2 AS party, * FROM reports)"""

CLEARING = FILLS + """, clearing AS (
  SELECT 'CLR' || off AS event_id, 'NOVATION' AS event_type, exec_id, member, ts FROM fills
  UNION ALL SELECT 'GUP' || off || 'G', 'GIVE_UP', exec_id, member, ts FROM fills
  UNION ALL SELECT 'GUP' || off || 'T', 'TAKE_UP', 'EXE' || (off + 1),
    'M' || ((user_id + 1) % 5), ts FROM fills)"""

REFDATA = """refdata AS (
  SELECT 'P' || p_partkey AS series, p_brand AS underlying, CAST(p_size AS BIGINT) AS multiplier
  FROM part)"""

LINES = """lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, 'P' || l_partkey AS series,
    CAST(l_quantity AS BIGINT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    l_shipdate AS exec_time FROM lineitem)"""

LOG = POSITIONS + """, position_log AS (
  SELECT *, (user_id % 10) % 3 AS part_no,
    row_number() OVER (PARTITION BY (user_id % 10) % 3 ORDER BY off) - 1 AS part_off FROM positions)"""

SHORT_ANY = CURRENT + """, short_any AS (
  SELECT DISTINCT series, member FROM current_state WHERE net < 0)"""
SHORT_NET = """, short_net AS (
  SELECT series, member FROM current_state GROUP BY series, member HAVING SUM(net) < 0)"""
SELLERS = """, sellers AS (SELECT DISTINCT series, member FROM fills WHERE side = 'SELL')"""

INFLATION = CURRENT + """, truth AS (
  SELECT series, CAST(SUM(abs(net)) AS BIGINT) AS total FROM current_state GROUP BY series),
 history AS (SELECT series, CAST(SUM(net) AS BIGINT) AS hist,
    CAST(SUM(abs(net)) AS BIGINT) AS abs_hist FROM positions GROUP BY series)"""

CANDIDATES = INFLATION + """, candidates AS (
  SELECT series, total, hist, c.condition, CASE c.condition WHEN 'latest' THEN total
    WHEN 'history_sum' THEN hist ELSE abs_hist END AS answer
  FROM truth JOIN history USING (series),
    (VALUES ('latest'), ('history_sum'), ('history_abs_sum')) AS c(condition))"""

SCALAR_SCORES = CANDIDATES + """, scored AS (
  SELECT series AS id, condition, printf('%.2f', total::DOUBLE) AS "right", printf('%.2f', hist::DOUBLE) AS known,
    CASE WHEN answer = total AND NOT (hist <> total AND answer = hist) THEN 'PASS'
      WHEN answer = hist THEN 'FAIL' ELSE 'REVIEW' END AS verdict FROM candidates)"""

JUDGED = r"""clean AS (
  SELECT doc_id, lang AS id, source AS condition, lower(regexp_replace(regexp_replace(
    coalesce(text, ''), '--[^\n]*', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
 flags AS (
  SELECT *, regexp_matches(t, 'the (and|with)') OR regexp_matches(t, 'with the') AS en_good,
    contains(t, 'http') AS http, contains(t, 'copyright') AS copyright,
    contains(t, 'der ') OR contains(t, 'die ') AS de_good,
    contains(t, 'le ') AND contains(t, 'ou') AS fr_right,
    contains(t, 'http') OR contains(t, 'license') AS fr_wrong,
    contains(t, 'el ') AS es_right, contains(t, 'los ') OR contains(t, '@') AS es_wrong
  FROM clean WHERE id IN ('en', 'de', 'fr', 'es')),
 judged AS (
  SELECT doc_id, id, condition,
    CASE id
      WHEN 'en' THEN CASE WHEN (http OR copyright) AND NOT en_good THEN 'FAIL'
        WHEN en_good THEN 'PASS' ELSE 'REVIEW' END
      WHEN 'de' THEN CASE WHEN http AND NOT contains(t, 'und ') THEN 'FAIL'
        WHEN de_good THEN 'PASS' ELSE 'REVIEW' END
      WHEN 'fr' THEN CASE WHEN fr_right AND NOT fr_wrong THEN 'PASS'
        WHEN fr_wrong AND NOT fr_right THEN 'FAIL' ELSE 'REVIEW' END
      ELSE CASE WHEN es_right AND NOT es_wrong THEN 'PASS'
        WHEN es_wrong AND NOT es_right THEN 'FAIL' ELSE 'REVIEW' END END AS text_verdict,
    CASE id
      WHEN 'en' THEN CASE WHEN (http OR copyright) AND NOT en_good
          THEN 'wrong pattern: /' || CASE WHEN http THEN 'http' ELSE 'copyright' END || '/'
        WHEN en_good THEN 'right pattern found' ELSE 'no pattern found' END
      WHEN 'de' THEN CASE WHEN http AND NOT contains(t, 'und ') THEN 'trap pattern'
        WHEN de_good THEN 'right pattern found' ELSE 'no pattern found' END
      WHEN 'fr' THEN CASE WHEN fr_right AND NOT fr_wrong THEN 'right sense'
        WHEN fr_wrong AND NOT fr_right THEN 'wrong sense'
        WHEN fr_right THEN 'both senses' ELSE 'neither sense' END
      ELSE CASE WHEN es_right AND NOT es_wrong THEN 'right sense'
        WHEN es_wrong AND NOT es_right THEN 'wrong sense'
        WHEN es_right THEN 'both senses' ELSE 'neither sense' END
      END AS text_detail
  FROM flags),
 labelled AS (
  SELECT j.*, CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 1 THEN 'PASS'
    WHEN quality = 0 THEN 'REVIEW' END AS label_verdict
  FROM judged j LEFT JOIN labels USING (doc_id)),
 card AS (
  SELECT doc_id, id, condition,
    CASE WHEN label_verdict IS NULL OR (label_verdict = 'REVIEW' AND text_verdict <> 'REVIEW')
      THEN text_verdict ELSE label_verdict END AS verdict,
    CASE WHEN label_verdict IS NULL THEN text_detail
      WHEN label_verdict = 'REVIEW' AND text_verdict <> 'REVIEW'
      THEN text_detail || ' (result inconclusive: by label)' ELSE 'by label' END AS detail
  FROM labelled)"""

RAW = """raw AS (
  SELECT event_id AS exec_id, CASE WHEN event_id % 70 = 0 THEN 'other' ELSE event_type END AS series,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS price,
    ts AS exec_time FROM events)"""

MOVED = FILLS + """, moved AS (
  SELECT *, CASE WHEN off % 2 = 0 THEN ts - INTERVAL 20 HOUR ELSE ts END AS bt FROM fills)"""

SKEW = MOVED + """, lags AS (
  SELECT epoch_us(ts) - epoch_us(bt) AS lag, CAST(ts AS DATE) <> CAST(bt AS DATE) AS other FROM moved),
 hist AS (SELECT lag, COUNT(*) AS n FROM lags GROUP BY lag),
 cum AS (SELECT lag, SUM(n) OVER (ORDER BY lag) AS c, SUM(n) OVER () AS total FROM hist)"""

QUESTIONS = """, numbers AS (
  SELECT 'q1_control_count' AS id, COUNT(*) AS truth, CAST(NULL AS BIGINT) AS distractor,
    '' AS label FROM fills
  UNION ALL SELECT 'q2_fanout_orders', COUNT(DISTINCT order_id), COUNT(*), 'count_star_fills' FROM fills
  UNION ALL SELECT 'q3_emir_trade_count', COUNT(DISTINCT uti), COUNT(*), 'report_record_count' FROM reports
  UNION ALL SELECT 'q4_live_trades', (SELECT COUNT(*) FROM live), COUNT(DISTINCT uti), 'all_utis' FROM reports
  UNION ALL SELECT 'q8_event_time', COUNT(*), NULL, '' FROM fills WHERE CAST(ts AS DATE) = DATE '2024-01-15')"""

# The texts of the runs, by number.
QUERY_TEXTS = """texts AS (SELECT * FROM (VALUES
  (0, 'SELECT COUNT(*) FROM f'), (1, 'SELECT count( DISTINCT  order_id ) FROM f'),
  (2, 'SELECT COUNT(order_id), COUNT(DISTINCT uti) FROM r'),
  (3, 'SELECT uti FROM r WHERE action NOT IN (''EROR'', ''TERM'')'),
  (4, 'SELECT SUM(ABS(net_quantity)) FROM p'),
  (5, 'SELECT SUM(net_quantity) FROM p WHERE _meta.offset = 3'),
  (6, 'SELECT counterparty_1 FROM `emir.trade-reports`'),
  (7, 'SELECT clearing_member_id FROM `etd.clearing-events` JOIN `emir.trade-reports` ON counterparty_1 = 1'),
  (8, 'SELECT m FROM p WHERE net_quantity < 0 AND side = ''SELL'''),
  (9, 'SELECT m FROM f WHERE side = ''SELL'' AND _meta.timestamp > 1'),
  (10, 'SELECT 1 FROM f WHERE exec_time > 1 -- COUNT(*)'),
  (11, 'SELECT clearing_member_id, row_number() OVER w FROM p'), (12, NULL)) AS t(i, x))"""

# Verdict and detail of a text for its question, from the rules as they are described.
TEXT_VERDICTS = r"""norm AS (
  SELECT *, lower(regexp_replace(regexp_replace(coalesce(sql, ''), '--[^\n]*', ' ', 'g'), '\s+', ' ', 'g')) AS t
  FROM runs),
 seen AS (
  SELECT *, regexp_matches(t, 'count\s*\(\s*\*\s*\)') AS stars,
    regexp_matches(t, 'count\s*\(\s*distinct\s+order_id') AS d_order,
    regexp_matches(t, 'count\s*\(\s*order_id\s*\)') AS c_order,
    regexp_matches(t, 'count\s*\(\s*distinct\s+uti') AS d_uti,
    regexp_matches(t, 'count\s*\(\s*report_id') AS c_report,
    contains(t, '_meta.offset') OR contains(t, 'latest') OR contains(t, 'row_number') AS newest,
    regexp_matches(t, 'sum\s*\(\s*(abs\s*\(\s*)?net_quantity') AS sums_up,
    contains(t, 'emir.trade-reports') AND contains(t, 'counterparty') AS parties,
    contains(t, 'clearing_member_id') OR contains(t, 'etd.clearing-events') AS members,
    regexp_matches(t, 'net_quantity\s*<\s*0') AS negative, regexp_matches(t, 'side\s*=\s*''sell''') AS sell
  FROM norm),
 texted AS (
  SELECT *, CASE id
    WHEN 'q1_control_count' THEN CASE WHEN regexp_matches(t, 'count\s*\(') THEN 'PASS|right pattern found'
      ELSE 'REVIEW|no pattern found' END
    WHEN 'q2_fanout_orders' THEN CASE WHEN d_order THEN 'PASS|right pattern found'
      WHEN stars THEN 'FAIL|wrong pattern: /count\s*\(\s*\*\s*\)/'
      WHEN c_order THEN 'FAIL|wrong pattern: /count\s*\(\s*order_id\s*\)/' ELSE 'REVIEW|no pattern found' END
    WHEN 'q3_emir_trade_count' THEN CASE WHEN d_uti THEN 'PASS|right pattern found'
      WHEN stars THEN 'FAIL|wrong pattern: /count\s*\(\s*\*\s*\)/'
      WHEN c_report THEN 'FAIL|wrong pattern: /count\s*\(\s*report_id/' ELSE 'REVIEW|no pattern found' END
    WHEN 'q4_live_trades' THEN CASE WHEN contains(t, 'eror') OR regexp_matches(t, 'not\s+in\s*\(')
      THEN 'PASS|right pattern found' ELSE 'REVIEW|no pattern found' END
    WHEN 'q5_open_interest' THEN CASE
      WHEN sums_up AND NOT (newest OR regexp_matches(t, 'max\s*\(')) THEN 'FAIL|adds up superseded snapshots'
      WHEN newest OR regexp_matches(t, 'max\s*\(\s*_meta') THEN 'PASS|right pattern found'
      ELSE 'REVIEW|no pattern found' END
    WHEN 'q6_counterparty_homonym' THEN CASE WHEN parties AND NOT members THEN 'PASS|reads the reported parties'
      WHEN members AND NOT parties THEN 'FAIL|reads clearing members as parties'
      WHEN parties THEN 'REVIEW|reads reported parties and members: see whether it joins them'
      ELSE 'REVIEW|reads neither' END
    WHEN 'q7_side_vs_direction' THEN CASE WHEN negative THEN 'PASS|right pattern found'
      WHEN sell THEN 'FAIL|wrong pattern: /side\s*=\s*''sell''/' ELSE 'REVIEW|no pattern found' END
    ELSE CASE WHEN contains(t, 'exec_time') THEN 'PASS|right pattern found'
      WHEN contains(t, '_meta.timestamp') THEN 'FAIL|wrong pattern: /_meta\.timestamp/'
      ELSE 'REVIEW|no pattern found' END END AS v
  FROM seen)"""

_TOP = """ SELECT party, COUNT(DISTINCT uti) AS n_trades FROM sides {where}
  GROUP BY party ORDER BY n_trades DESC, party LIMIT 10"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


_TOPIC_COUNTS = """counts AS (
  SELECT 'etd.executions' AS topic, COUNT(*) AS n_records, COUNT(DISTINCT exec_id) AS n_keys,
    MAX(off) AS last_offset FROM fills
  UNION ALL SELECT 'etd.clearing-events', COUNT(*) * 3, COUNT(*) * 3, MAX(off) * 3 + 2 FROM fills
  UNION ALL SELECT 'etd.positions', COUNT(*), COUNT(DISTINCT position_key), MAX(part_off)
    FROM position_log
  UNION ALL SELECT 'emir.trade-reports', COUNT(*), COUNT(DISTINCT report_id), MAX(roff) FROM reports
  UNION ALL SELECT 'refdata.contracts', COUNT(*) * 2, COUNT(DISTINCT p_partkey), 2 FROM part)"""

# FILLS opens both; the second part continues the list.
_ALL_TOPICS = LOG + REPORTS.removeprefix(FILLS) + ", " + _TOPIC_COUNTS

ORACLES: dict[str, str] = {
    "topic_snapshot": _with(LOG, """SELECT position_key AS _key, part_no AS log_partition,
        part_off AS log_offset, net AS net_quantity, as_of_time FROM position_log"""),
    "decode_json_props":
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "conform_fills": _with(RAW, "SELECT *, CAST(NULL AS VARCHAR) AS venue FROM raw"),
    "flatten_nested": """SELECT event_id, event_type AS body_type, value AS body_measure_value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS body_measure_k FROM events""",
    "conformance_report": _with(RAW, """, n AS (SELECT COUNT(*) AS n FROM raw)
        SELECT c.column_name, n.n AS rows, CASE c.column_name WHEN 'venue' THEN n.n ELSE 0 END AS nulls,
          CASE c.column_name WHEN 'price' THEN (SELECT COUNT(*) FROM raw WHERE price IS NULL)
            ELSE 0 END AS failed_casts,
          CASE c.column_name WHEN 'series' THEN (SELECT COUNT(*) FROM raw WHERE series NOT IN
            ('view', 'click', 'purchase', 'signup', 'error')) ELSE 0 END AS outside_enum
        FROM n, (VALUES ('exec_id'), ('series'), ('price'), ('exec_time'), ('venue')) AS c(column_name)"""),
    "encode_collections": """SELECT page_id,
        CAST(to_json(string_split(url, '/')) AS VARCHAR) AS parts,
        '{"size":' || length(html) || '}' AS facts FROM pages""",
    "topic_counts": _with(_ALL_TOPICS, "SELECT topic, n_records, n_keys FROM counts"),
    "uti_lookup": _with(REPORTS, """SELECT roff AS log_offset, report_id, uti, action AS action_type
        FROM reports WHERE roff // 4 IN (7, 20, 21, 999)"""),
    "rewritten_log": _with(_ALL_TOPICS, "SELECT topic, n_records, n_keys FROM counts"),
    "written_topic": _with(_ALL_TOPICS, "SELECT * FROM counts"),
    "fields_as_text": """SELECT page_id, CAST(length(html) AS VARCHAR) AS size,
        CAST(to_json(string_split(url, '/')) AS VARCHAR) AS parts,
        '{"size":' || length(html) || '}' AS facts FROM pages""",
    "topic_sql": _with(LAST_ACTION, """SELECT series AS contract_series, COUNT(*) AS n_live
        FROM live JOIN (SELECT 'UTI' || off AS uti, series FROM fills) USING (uti) GROUP BY 1"""),
    "encode_topic": _with(FILLS, """SELECT exec_id AS _key, order_id, series AS contract_series, side,
        qty AS quantity, price, member AS executing_member, ts AS exec_time FROM fills"""),
    "assign_offsets": _with(LOG, """SELECT position_key, off AS sent, part_no AS log_partition,
        part_off AS log_offset FROM position_log"""),
    "type_drift": _with(FILLS, """SELECT field, COUNT(off) FILTER (field <> 'order_id' OR off % 100 <> 4)
          AS n_records, TRUE AS declared, field = 'quantity' AS mixed
        FROM fills, (VALUES ('exec_id'), ('order_id'), ('contract_series'), ('side'), ('quantity'),
          ('price'), ('executing_member'), ('exec_time')) AS f(field) GROUP BY field"""),
    "variant_fields": """WITH k AS (SELECT event_id, event_id % 7 AS m,
            CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, CASE m WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'array'
            WHEN 3 THEN 'object' WHEN 4 THEN 'boolean' END AS k_kind,
          CASE m WHEN 0 THEN k::VARCHAR WHEN 1 THEN k::VARCHAR WHEN 2 THEN '[' || k || ']'
            WHEN 3 THEN '{"a":' || k || '}' WHEN 4 THEN 'true' END AS k_text,
          CASE WHEN m < 2 THEN k END AS k_number FROM k""",
    "field_drift": """SELECT field, COUNT(*) * 2 AS n_records, field <> 'version' AS declared
        FROM part, (VALUES ('contract_series'), ('product_type'), ('underlying'),
          ('contract_multiplier'), ('expiry_date'), ('version')) AS f(field) GROUP BY field""",
    "split_position_key": _with(POSITIONS, """SELECT DISTINCT position_key, member, account, series
        FROM positions"""),
    "both_sides": _with(REPORTS + SIDES, "SELECT report_id, uti, party FROM sides"),
    "series_fills": _with(FILLS, """SELECT exec_id, series AS contract_series, side, qty AS quantity
        FROM fills WHERE series = 'purchase'"""),
    "fills_on_date": _with(FILLS, """SELECT COUNT(*) AS n_fills FROM fills
        WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'"""),
    "default_filtered_reports": _with(REPORTS, """SELECT report_id, action AS action_type, notional
        FROM reports WHERE action <> 'EROR' AND currency <> 'GBP'"""),
    "count_fills": "SELECT COUNT(*) AS n_fills FROM events",
    "count_orders": "SELECT COUNT(DISTINCT l_orderkey) AS n_orders FROM lineitem",
    "count_trades": _with(REPORTS, "SELECT COUNT(DISTINCT uti) AS n_trades FROM reports"),
    "count_reports": _with(REPORTS, "SELECT COUNT(*) AS n_reports FROM reports"),
    "live_trades": _with(LAST_ACTION, "SELECT COUNT(*) AS n_live FROM live"),
    "live_trades_anti": _with(REPORTS, """SELECT COUNT(DISTINCT uti) AS n_live FROM reports
        WHERE uti NOT IN (SELECT uti FROM reports WHERE action IN ('EROR', 'TERM'))"""),
    "live_trades_semi": _with(REPORTS, """SELECT COUNT(DISTINCT uti) AS n_live FROM reports
        WHERE (uti, rts) IN (SELECT (uti, MAX(rts)) FROM reports GROUP BY uti)
        AND action NOT IN ('EROR', 'TERM')"""),
    "all_utis_distractor": _with(REPORTS, """SELECT COUNT(DISTINCT uti) AS n_utis FROM reports
        WHERE action NOT IN ('EROR', 'TERM')"""),
    "fills_by_date": """SELECT CAST(ts AS DATE) AS trade_date, COUNT(*) AS n_fills
        FROM events GROUP BY 1""",
    "total_abs_net": _with(INFLATION, """SELECT series AS contract_series, total AS total_abs_net
        FROM truth"""),
    "open_interest": _with(INFLATION, """SELECT series AS contract_series,
        CAST(total / 2.0 AS DECIMAL(18,2)) AS open_interest FROM truth"""),
    "history_sum": _with(INFLATION, "SELECT series AS contract_series, hist AS history_sum FROM history"),
    "history_abs_sum": _with(INFLATION, """SELECT series AS contract_series, abs_hist AS history_abs_sum
        FROM history"""),
    "short_members_net": _with(CURRENT + SHORT_NET, """SELECT series AS contract_series,
        member AS clearing_member_id FROM short_net"""),
    "short_members_any": _with(SHORT_ANY, """SELECT series AS contract_series,
        member AS clearing_member_id FROM short_any"""),
    "short_anytime_members": _with(POSITIONS, """SELECT DISTINCT series AS contract_series,
        member AS clearing_member_id FROM positions WHERE net < 0"""),
    "short_members_either": _with(SHORT_ANY + SHORT_NET, """SELECT series AS contract_series,
        member AS clearing_member_id FROM (SELECT * FROM short_any UNION SELECT * FROM short_net)"""),
    "sell_side_members": _with(FILLS + SELLERS, """SELECT series AS contract_series,
        member AS clearing_member_id FROM sellers"""),
    "sell_not_short": _with(SHORT_ANY + SELLERS, """SELECT series AS contract_series,
        member AS clearing_member_id FROM (SELECT * FROM sellers EXCEPT SELECT * FROM short_any)"""),
    "sell_and_short": _with(SHORT_ANY + SELLERS, """SELECT series AS contract_series,
        member AS clearing_member_id FROM (SELECT * FROM sellers INTERSECT SELECT * FROM short_any)"""),
    "current_net_positions": _with(CURRENT, """SELECT member AS clearing_member_id, account,
        series AS contract_series, net AS net_quantity FROM current_state"""),
    "net_from_fills": _with(FILLS, """SELECT member AS clearing_member_id, account,
        series AS contract_series,
        CAST(SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS net_quantity
        FROM fills GROUP BY 1, 2, 3"""),
    "latest_per_key": _with(CURRENT, """SELECT off AS log_offset, position_key,
        member AS clearing_member_id, account, series AS contract_series, net AS net_quantity,
        as_of_time FROM current_state"""),
    "latest_action": _with(LAST_ACTION, """SELECT uti, action AS action_type,
        rts AS reporting_timestamp, roff AS log_offset FROM last_action"""),
    "running_positions": _with(POSITIONS, """SELECT off AS log_offset, position_key,
        net AS net_quantity FROM positions"""),
    "positions_as_of": _with(POSITIONS, """, ranked AS (SELECT *, row_number() OVER (
          PARTITION BY member, account, series ORDER BY off DESC) AS rn FROM positions
          WHERE off <= (SELECT MAX(off) // 2 FROM fills))
        SELECT member AS clearing_member_id, account, series AS contract_series,
          net AS net_quantity FROM ranked WHERE rn = 1"""),
    "trades_per_party": _with(REPORTS + SIDES, """SELECT party, COUNT(DISTINCT uti) AS n_trades
        FROM sides GROUP BY party"""),
    "live_trades_per_party": _with(LAST_ACTION + SIDES, """SELECT party,
        COUNT(DISTINCT uti) AS n_trades FROM sides WHERE uti IN (SELECT uti FROM live)
        GROUP BY party"""),
    "party_activity": _with(REPORTS + SIDES, """SELECT party, COUNT(*) AS n_reports,
        CAST(SUM(notional) AS DECIMAL(28,2)) AS total_notional, MIN(rts) AS first_report,
        MAX(rts) AS last_report, COUNT(DISTINCT currency) AS n_currencies
        FROM sides GROUP BY party"""),
    "top_parties": _with(REPORTS + SIDES, _TOP.format(where="")),
    "week_top_parties": _with(REPORTS + SIDES, _TOP.format(where="""WHERE
        rts >= date_trunc('week', TIMESTAMP '2024-01-20 12:00:00')
        AND rts < TIMESTAMP '2024-01-20 12:00:00'""")),
    "last7d_top_parties": _with(REPORTS + SIDES, _TOP.format(where="""WHERE
        rts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY
        AND TIMESTAMP '2024-01-20 12:00:00'""")),
    "fills_with_orders": _with(LINES, """SELECT l.order_id, line, series AS contract_series,
        qty AS quantity, price, exec_time, o_custkey AS account, o_orderdate AS submitted_at
        FROM lines l JOIN orders ON order_id = o_orderkey"""),
    "notional_by_underlying": _with(LINES + ", " + REFDATA, """SELECT underlying, COUNT(*) AS n_fills,
        CAST(SUM(CAST(round((CAST(price AS DECIMAL(17,6)) + line * 0.0005) * multiplier * qty, 2)
          AS DECIMAL(28,2))) AS DECIMAL(38,2)) AS notional
        FROM lines JOIN refdata USING (series) GROUP BY underlying"""),
    "notional_as_of": _with(FILLS, """, v AS (
          SELECT series, ts, max(off) AS version,
            arg_max(CASE WHEN off % 5 > 0 THEN [off % 7 + 1] ELSE [NULL] END, off)[1] AS multiplier
          FROM fills WHERE off % 97 < 2 AND series <> 'error' GROUP BY series, ts)
        SELECT f.series AS contract_series, COUNT(*) AS n_fills, COUNT(version) AS n_with_version,
          CAST(SUM(qty * multiplier) AS BIGINT) AS lots, CAST(SUM(version) AS BIGINT) AS sum_version
        FROM fills f ASOF LEFT JOIN v ON f.series = v.series AND f.ts >= v.ts GROUP BY f.series"""),
    "reports_with_fills": _with(REPORTS, """SELECT r.exec_id, report_id, uti, action AS action_type,
        f.side, f.qty AS quantity, f.series AS contract_series
        FROM reports r LEFT JOIN fills f USING (exec_id)"""),
    "clearing_with_fills": _with(CLEARING, """SELECT c.exec_id, event_id, event_type, f.side,
        f.qty AS quantity, f.series AS contract_series
        FROM clearing c LEFT JOIN fills f USING (exec_id)"""),
    "pair_transfers": _with(CLEARING, """SELECT left(g.event_id, length(g.event_id) - 1) AS transfer_id,
        g.member AS from_member, t.member AS to_member, g.ts + INTERVAL 30 SECOND AS event_time
        FROM clearing g JOIN clearing t ON left(g.event_id, length(g.event_id) - 1)
          = left(t.event_id, length(t.event_id) - 1)
        WHERE g.event_type = 'GIVE_UP' AND t.event_type = 'TAKE_UP'"""),
    "grain_audit": """SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_keys,
        COUNT(*) FILTER (n > 1) AS n_repeated_keys, MAX(n) AS max_rows_per_key
        FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "fanout_audit": """WITH c AS (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1),
        p AS (SELECT DISTINCT o_orderkey AS k FROM orders)
        SELECT COUNT(p.k) AS n_parents, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_children,
          COUNT(*) FILTER (p.k IS NOT NULL AND n IS NULL) AS n_childless_parents,
          CAST(COALESCE(SUM(n) FILTER (p.k IS NULL), 0) AS BIGINT) AS n_orphans,
          COALESCE(MAX(n) FILTER (p.k IS NOT NULL), 0) AS max_children
        FROM p FULL JOIN c ON p.k = c.k""",
    "homonym_matrix": _with(REPORTS + CLEARING.replace(FILLS, ""), """, v AS (
          SELECT DISTINCT c, v FROM (
            SELECT unnest(['fills.exec_id', 'fills.order_id', 'fills.executing_member']) AS c,
              unnest([exec_id, order_id, member]) AS v FROM fills
            UNION ALL SELECT unnest(['reports.uti', 'reports.exec_id', 'reports.counterparty_1',
              'reports.counterparty_2']), unnest([uti, exec_id, cp1, cp2]) FROM reports
            UNION ALL SELECT unnest(['clearing.event_id', 'clearing.exec_id',
              'clearing.clearing_member_id']), unnest([event_id, exec_id, member]) FROM clearing)),
        n AS (SELECT c, COUNT(*) AS n FROM v GROUP BY c),
        m AS (SELECT a.c AS l, b.c AS r, COUNT(*) AS n FROM v a JOIN v b USING (v) WHERE a.c < b.c GROUP BY 1, 2)
        SELECT a.c AS left_column, b.c AS right_column,
          coalesce(m.n, 0) < 0.01 * least(a.n, b.n) AS unlike
        FROM n a JOIN n b ON a.c < b.c LEFT JOIN m ON m.l = a.c AND m.r = b.c"""),
    "lag_sketches": _with(FILLS, """, s AS (
          SELECT CAST(ts - to_seconds((off * 7919) % 86399) AS DATE) AS d FROM fills)
        SELECT scope, p, COUNT(*) AS n_rows, TRUE AS near
        FROM s, (VALUES ('all'), ('until')) AS c(scope), (VALUES (50), (90), (99)) AS q(p)
        WHERE scope = 'all' OR d <= DATE '2024-01-15' GROUP BY scope, p"""),
    "party_trade_sketches": _with(REPORTS + SIDES, """SELECT party, COUNT(*) AS n_rows,
        COUNT(DISTINCT uti) AS n_trades, TRUE AS near FROM sides GROUP BY party"""),
    "homonym_audit": _with(REPORTS + SIDES, """SELECT (SELECT COUNT(DISTINCT party) FROM sides) AS n_left,
          (SELECT COUNT(DISTINCT member) FROM fills) AS n_right, c.n AS n_common,
          CAST(c.n AS DOUBLE) / least((SELECT COUNT(DISTINCT party) FROM sides),
            (SELECT COUNT(DISTINCT member) FROM fills)) AS share, c.n = 0 AS unlike,
          'party/member' AS pair
        FROM (SELECT COUNT(DISTINCT party) AS n FROM sides WHERE party IN (SELECT member FROM fills)) c
        UNION ALL SELECT COUNT(DISTINCT member), COUNT(DISTINCT member), COUNT(DISTINCT member), 1.0,
          COUNT(DISTINCT member) = 0, 'member/member' FROM fills
        UNION ALL SELECT o, e, k, CAST(k AS DOUBLE) / least(o, e), CAST(k AS DOUBLE) / least(o, e) < 0.01,
          'order/execution' FROM (SELECT COUNT(DISTINCT order_id) AS o,
            COUNT(DISTINCT CASE WHEN off = 7 THEN 'ORD1' ELSE exec_id END) AS e,
            COUNT(DISTINCT CASE WHEN off = 7 THEN 'ORD1' END) AS k FROM fills)"""),
    "dual_side_audit": _with(REPORTS, """, g AS (SELECT uti, action, COUNT(*) AS n,
          MIN(cp1) AS a, MAX(cp1) AS b, MIN(cp2) AS c, MAX(cp2) AS d
          FROM reports WHERE roff % 160 <> 21 GROUP BY 1, 2)
        SELECT action AS action_type, COUNT(*) AS n_groups,
          COUNT(*) FILTER (n = 2 AND a = c AND b = d AND a <> b) AS n_mirrored,
          COUNT(*) FILTER (NOT (n = 2 AND a = c AND b = d AND a <> b)) AS n_unmirrored
        FROM g GROUP BY action"""),
    "order_audit": _with(MOVED, """, r AS (SELECT member, account, series,
          row_number() OVER (PARTITION BY member, account, series ORDER BY off DESC) AS by_off,
          row_number() OVER (PARTITION BY member, account, series ORDER BY bt DESC, off DESC) AS by_time
          FROM moved)
        SELECT COUNT(*) AS n_keys, COUNT(*) FILTER (by_time <> 1) AS n_out_of_order
        FROM r WHERE by_off = 1"""),
    "history_inflation": _with(INFLATION, """SELECT series AS contract_series, total AS total_abs_net,
        hist AS history_sum, abs_hist AS history_abs_sum FROM truth JOIN history USING (series)"""),
    "position_reconcile": _with(CURRENT, """, s AS (SELECT member, account, series,
          SUM(CASE WHEN side = 'BUY' THEN more ELSE -more END) AS filled FROM (SELECT *,
            qty + CASE WHEN off % 50 = 0 THEN 0.25 ELSE 0.00 END AS more FROM fills) GROUP BY 1, 2, 3)
        SELECT COUNT(*) AS n_keys,
          COUNT(*) FILTER (COALESCE(net, 0) <> COALESCE(filled, 0)) AS n_different,
          CAST(COALESCE(SUM(abs(COALESCE(net, 0) - COALESCE(filled, 0))), 0) AS DECIMAL(38,2))
            AS total_difference
        FROM current_state FULL JOIN s USING (member, account, series)"""),
    "ingest_skew": _with(SKEW, """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (other) AS n_other_date,
        CAST(SUM(lag) // COUNT(*) AS BIGINT) AS avg_lag_us, MAX(lag) AS max_lag_us,
        (SELECT MIN(lag) FROM cum WHERE c * 100 >= total * 50) AS p50_lag_us,
        (SELECT MIN(lag) FROM cum WHERE c * 100 >= total * 90) AS p90_lag_us,
        (SELECT MIN(lag) FROM cum WHERE c * 100 >= total * 99) AS p99_lag_us FROM lags"""),
    "score_text": _with(JUDGED, "SELECT doc_id, id, condition, text_verdict, text_detail FROM judged"),
    "score_scalar": _with(SCALAR_SCORES, """SELECT id, condition, verdict AS result_verdict,
        CASE verdict WHEN 'PASS' THEN "right" || ', as expected'
          WHEN 'FAIL' THEN known || ' is history_sum; expected ' || "right"
          ELSE 'expected ' || "right" || ', not among numbers seen: 1' END AS result_detail FROM scored"""),
    "score_groups": _with(CURRENT, """, t AS (SELECT account, series, SUM(abs(net)) AS total
          FROM current_state GROUP BY 1, 2),
        h AS (SELECT account, series, SUM(net) AS hist, SUM(abs(net)) AS abs_hist
          FROM positions GROUP BY 1, 2),
        candidates AS (SELECT account, total, hist, c.condition, CASE c.condition
            WHEN 'latest' THEN total WHEN 'history_sum' THEN hist ELSE abs_hist END AS answer
          FROM t JOIN h USING (account, series),
            (VALUES ('latest'), ('history_sum'), ('history_abs_sum')) AS c(condition)),
        n AS (SELECT account, condition, COUNT(*) AS groups,
          COUNT(*) FILTER (answer = total OR answer = abs(total)) AS ok,
          COUNT(*) FILTER (answer <> total AND answer <> abs(total) AND answer = hist) AS wrong
          FROM candidates GROUP BY 1, 2)
        SELECT account AS id, condition, CASE WHEN ok = groups THEN 'PASS'
            WHEN wrong > 0 THEN 'FAIL' ELSE 'REVIEW' END AS result_verdict,
          CASE WHEN ok = groups THEN 'all groups match'
            WHEN wrong > 0 THEN wrong || ' groups match the distractor'
            ELSE ok || '/' || groups END AS result_detail FROM n"""),
    "score_members": _with(SHORT_ANY + SELLERS, """, ever AS (
          SELECT DISTINCT series, member FROM positions WHERE net < 0),
        answers AS (SELECT *, 'latest' AS condition FROM short_any
          UNION ALL SELECT *, 'sell_side' FROM sellers UNION ALL SELECT *, 'anytime' FROM ever),
        n AS (SELECT a.series, a.condition, COUNT(s.member) AS found,
            COUNT(*) FILTER (s.member IS NULL) AS extra,
            MIN(a.member) FILTER (s.member IS NULL) AS lo, MAX(a.member) FILTER (s.member IS NULL) AS hi
          FROM answers a LEFT JOIN short_any s ON a.series = s.series AND a.member = s.member
          GROUP BY 1, 2)
        SELECT series AS id, condition, CASE WHEN extra > 0 THEN 'FAIL' WHEN found > 0 THEN 'PASS'
            ELSE 'REVIEW' END AS result_verdict,
          CASE WHEN extra > 0 THEN extra || ' unexpected members, from ' || lo || ' to ' || hi
            WHEN found > 0 THEN found || ' expected members'
            ELSE 'no known member in the answer' END AS result_detail FROM n"""),
    "combine_verdicts": _with(JUDGED, "SELECT * FROM card"),
    "pass_rates": _with(JUDGED, """SELECT condition, COUNT(*) AS n_cells,
        COUNT(*) FILTER (verdict = 'PASS') AS n_pass, COUNT(*) FILTER (verdict = 'REVIEW') AS n_review,
        CAST(COUNT(*) FILTER (verdict = 'PASS') AS DOUBLE) / COUNT(*) AS pass_rate
        FROM card GROUP BY condition"""),
    "content_effect": _with(JUDGED, """, r AS (SELECT condition,
          CAST(COUNT(*) FILTER (verdict = 'PASS') AS DOUBLE) / COUNT(*) AS rate
          FROM card GROUP BY condition)
        SELECT a.rate AS treated_rate, b.rate AS control_rate, a.rate - b.rate AS content_effect
        FROM r a, r b WHERE a.condition = 'src1' AND b.condition = 'src2'"""),
    "scorecard_matrix": _with(SCALAR_SCORES, """SELECT id,
        MAX(verdict) FILTER (condition = 'latest') AS latest,
        MAX(verdict) FILTER (condition = 'history_sum') AS history_sum,
        MAX(verdict) FILTER (condition = 'history_abs_sum') AS history_abs_sum
        FROM scored GROUP BY id"""),
    "question_truth": _with(LAST_ACTION, QUESTIONS + " SELECT id, truth, distractor FROM numbers"),
    "question_text_scores": "WITH " + QUERY_TEXTS + """, runs AS (
          SELECT p_partkey, list_extract(['q1_control_count', 'q2_fanout_orders', 'q3_emir_trade_count',
              'q4_live_trades', 'q5_open_interest', 'q6_counterparty_homonym', 'q7_side_vs_direction',
              'q8_event_time'], CAST(p_partkey % 8 + 1 AS BIGINT)) AS id,
            texts.x || ' -- ' || p_name || ' exec_time' AS sql
          FROM part JOIN texts ON texts.i = (p_partkey * 7 + p_size) % 13), """ + TEXT_VERDICTS + """
        SELECT p_partkey, id, split_part(v, '|', 1) AS text_verdict, split_part(v, '|', 2) AS text_detail
        FROM texted""",
    "benchmark_scorecard": _with(
        LAST_ACTION + POSITIONS.removeprefix(FILLS) + CURRENT.removeprefix(POSITIONS)
        + SHORT_NET + """, short_any AS (SELECT DISTINCT series, member FROM current_state WHERE net < 0)"""
        + INFLATION.removeprefix(CURRENT) + SELLERS,
        QUESTIONS + ", " + QUERY_TEXTS + """, wanted AS (
          SELECT member FROM short_any WHERE series = 'purchase'
          UNION SELECT member FROM short_net WHERE series = 'purchase'),
        kinds AS (SELECT * FROM (VALUES (0, 'right'), (1, 'wrong'), (2, 'both'), (3, 'none'),
          (4, 'bare'), (5, 'silent')) AS k(c, condition)),
        asked AS (SELECT * FROM (VALUES (0, 'q1_control_count'), (1, 'q2_fanout_orders'),
          (2, 'q3_emir_trade_count'), (3, 'q4_live_trades'), (4, 'q5_open_interest'),
          (5, 'q6_counterparty_homonym'), (6, 'q7_side_vs_direction'), (7, 'q8_event_time')) AS a(q, id)),
        runs AS (SELECT id, condition, texts.x AS sql FROM asked CROSS JOIN kinds
          JOIN texts ON texts.i = (q * 6 + c) % 13), """ + TEXT_VERDICTS + """,
        given AS (
          SELECT id, truth, distractor, label, condition, CASE condition WHEN 'right' THEN [truth]
            WHEN 'wrong' THEN [coalesce(distractor, truth + 1)]
            WHEN 'both' THEN [truth, coalesce(distractor, truth + 1)] ELSE [-1] END AS nums
          FROM numbers, kinds WHERE condition IN ('right', 'wrong', 'both', 'none')),
        flagged AS (SELECT *, list_contains(nums, truth) AS hit,
            coalesce(distractor <> truth AND list_contains(nums, distractor), false) AS tripped FROM given),
        by_series AS (
          SELECT condition, total, hist, CASE condition WHEN 'right' THEN total WHEN 'wrong' THEN hist
            WHEN 'both' THEN CASE WHEN series = 'purchase' THEN total ELSE hist END ELSE -1 END AS answer
          FROM truth JOIN history USING (series), kinds WHERE condition IN ('right', 'wrong', 'both', 'none')),
        grouped AS (
          SELECT condition, COUNT(*) AS n, COUNT(*) FILTER (answer = total OR answer = abs(total)) AS ok,
            COUNT(*) FILTER (NOT (answer = total OR answer = abs(total)) AND answer = hist) AS wrong
          FROM by_series GROUP BY condition),
        named AS (
          SELECT 'right' AS condition, member FROM wanted
          UNION SELECT 'wrong', member FROM sellers WHERE series = 'purchase'
          UNION SELECT 'both', member FROM wanted
          UNION SELECT 'both', member FROM sellers WHERE series = 'purchase'),
        counted AS (
          SELECT k.condition, COUNT(*) FILTER (member IN (SELECT member FROM wanted)) AS found,
            COUNT(*) FILTER (member NOT IN (SELECT member FROM wanted)) AS extra,
            MIN(member) FILTER (member NOT IN (SELECT member FROM wanted)) AS lo,
            MAX(member) FILTER (member NOT IN (SELECT member FROM wanted)) AS hi
          FROM kinds k LEFT JOIN named n ON n.condition = k.condition
          WHERE k.condition <> 'silent' GROUP BY k.condition),
        results AS (
          SELECT id, condition, CASE WHEN hit AND NOT tripped THEN 'PASS|' || t || ', as expected'
            WHEN tripped AND NOT hit THEN 'FAIL|' || d || ' is ' || label || '; expected ' || t
            WHEN hit AND tripped THEN 'REVIEW|' || t || ' as expected, but also ' || d || ', ' || label
            ELSE 'REVIEW|expected ' || t || ', not among numbers seen: ' || len(nums) END AS r
          FROM (SELECT *, printf('%.2f', truth::DOUBLE) AS t, printf('%.2f', distractor::DOUBLE) AS d FROM flagged)
          UNION ALL SELECT 'q5_open_interest', condition, CASE WHEN ok = n THEN 'PASS|all groups match'
            WHEN wrong > 0 THEN 'FAIL|' || wrong || ' groups match the distractor'
            ELSE 'REVIEW|' || ok || '/' || n END FROM grouped
          UNION ALL SELECT 'q5_open_interest', 'bare', 'PASS|sum over the groups matches'
            FROM (SELECT SUM(total) AS t FROM truth) a JOIN (SELECT SUM(abs(net)) AS t FROM current_state) b
            ON a.t = b.t
          UNION ALL SELECT 'q7_side_vs_direction', condition,
            CASE WHEN extra > 0 THEN 'FAIL|' || extra || ' unexpected members, from ' || lo || ' to ' || hi
              WHEN found > 0 THEN 'PASS|' || found || ' expected members'
              ELSE 'REVIEW|no known member in the answer' END FROM counted),
        parts AS (
          SELECT t.id, t.condition, split_part(v, '|', 1) AS text_verdict, split_part(v, '|', 2) AS text_detail,
            nullif(split_part(r, '|', 1), '') AS result_verdict,
            CASE WHEN r IS NOT NULL THEN split_part(r, '|', 2) END AS result_detail
          FROM texted t LEFT JOIN results USING (id, condition))
        SELECT id, condition, CASE WHEN result_verdict IS NULL
              OR (result_verdict = 'REVIEW' AND text_verdict <> 'REVIEW') THEN text_verdict
            ELSE result_verdict END AS verdict,
          CASE WHEN result_verdict IS NULL THEN text_detail
            WHEN result_verdict = 'REVIEW' AND text_verdict <> 'REVIEW'
            THEN text_detail || ' (result inconclusive: ' || result_detail || ')'
            ELSE result_detail END AS detail,
          text_verdict, text_detail, result_verdict, result_detail FROM parts"""),
    "stream_latest": """SELECT user_id, event_id, event_type, ts FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "stream_topic_positions": _with(CURRENT, """SELECT position_key AS _key, net AS net_quantity
        FROM current_state"""),
    "stream_net_positions": _with(FILLS, """SELECT member AS clearing_member_id, account,
        series AS contract_series,
        CAST(SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS net_quantity
        FROM fills GROUP BY 1, 2, 3"""),
    "stream_fills_by_date": """SELECT CAST(ts AS DATE) AS trade_date, COUNT(*) AS n_fills
        FROM events GROUP BY 1""",
    "stream_log_dedup": _with(FILLS, "SELECT exec_id AS _key, 1::BIGINT AS n FROM fills"),
    "stream_dedup": _with(FILLS, "SELECT exec_id, ts AS exec_time FROM fills"),
    "stream_state_table": _with(CURRENT, """SELECT c.member AS clearing_member_id, c.account,
        c.series AS contract_series, f.exec_id, c.off AS log_offset
        FROM current_state c JOIN fills f ON c.off = f.off"""),
}

# The same rows, found another way.
ORACLES["observed_conformance"] = ORACLES["conformance_report"]
ORACLES["stream_state_positions"] = ORACLES["stream_net_positions"]
