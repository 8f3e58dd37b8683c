"""DuckDB SQL for each query, over the same derived tables.

Written from the rules rather than from the Spark plans: where a plan uses a
shortcut (closing rows, ordinals, reduced patches) the SQL here states the
result directly.
"""

from __future__ import annotations

from fieldloom import dimensions
from fieldloom.operators.matching import PROMPT_TEMPLATE
from fieldloom.sources.derived import LINE_VIEWS, VIEWS, dialect


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ACCEPTED = ", ".join(_text(t) for t in dimensions.ACCEPTED_TYPES)
_PRESET_ROWS = ", ".join(
    f"({i}, {_text(group)}, {_text(key)}, {_text(label)}, {_text(category)}, {str(required).upper()})"
    for i, (group, category, key, label, required) in enumerate(
        ((g, c, *f) for g, c, fields in dimensions.PRESET_GROUPS for f in fields), 1))
_TYPE_ROWS = ", ".join(
    "({}, {}, {})".format(*(_text(v) if v else "NULL" for v in row)) for row in dimensions.FIELD_TYPES)

RATE = "CASE WHEN {whole} > 0 THEN CAST(printf('%.2f', {part} / {whole}) AS DOUBLE) ELSE 0.0 END"

_LAST_BRACKET = "length(output_text) - strpos(reverse(output_text), ']') + 1"


def _answers(source: str) -> str:
    """Verdict and sliced array of each model output."""
    return f"""
        SELECT request_id, slice,
          CASE WHEN status_code <> 200 THEN 'api_error' WHEN slice IS NULL THEN 'no_array'
               WHEN NOT json_valid(slice) THEN 'parse_error' ELSE 'ok' END AS answer_verdict
        FROM (SELECT request_id, status_code,
                CASE WHEN strpos(output_text, '[') > 0 AND strpos(output_text, ']') > 0 THEN
                  substr(output_text, strpos(output_text, '['),
                         {_LAST_BRACKET} - strpos(output_text, '[') + 1) END AS slice
              FROM {source})"""


def _matches(answers: str) -> str:
    """Objects whose three attributes are strings, absent ones filled in."""
    def attribute(key: str, default: str) -> str:
        return (f"CASE WHEN (e->'{key}') IS NULL THEN '{default}' "
                f"WHEN json_type(e->'{key}') = 'VARCHAR' THEN e->>'{key}' END AS {key}")

    return f"""
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY i) - 1 AS pos,
          field_name, field_type, matched_value
        FROM (SELECT request_id, i, {attribute("field_name", "")}, {attribute("field_type", "text")},
                {attribute("matched_value", "")}
              FROM (SELECT request_id, unnest(json_extract(slice, '$[*]')) AS e,
                      unnest(range(json_array_length(slice)::BIGINT)) AS i
                    FROM {answers} WHERE answer_verdict = 'ok')
              WHERE json_type(e) = 'OBJECT')
        WHERE field_name IS NOT NULL AND field_type IS NOT NULL AND matched_value IS NOT NULL"""


_SHARED = {
    **{name: dialect(text, "duckdb") for name, text in {**VIEWS, **LINE_VIEWS}.items()},
    "stored_users": dialect(VIEWS["users"], "duckdb"),
    "users": "SELECT user_id, email, lower(status) AS status, created_at, updated_at FROM stored_users",
    "stored_codes": dialect(VIEWS["activation_codes"], "duckdb"),
    "activation_codes": "SELECT * REPLACE (lower(status) AS status) FROM stored_codes",
    "preset": f"SELECT * FROM (VALUES {_PRESET_ROWS}) v(position, \"group\", key, label, category, required)",
    "types": f"SELECT * FROM (VALUES {_TYPE_ROWS}) v(type, name, description)",
    "entries": """
        SELECT resume_id, user_id, pos, key, json_extract_string(fields, key) AS value
        FROM (SELECT resume_id, user_id, fields, unnest(json_keys(fields)) AS key,
                unnest(range(len(json_keys(fields)))) AS pos FROM resumes)""",
    "texts": """
        SELECT r.resume_id, r.user_id, coalesce(t.resume_text, '') AS resume_text
        FROM resumes r LEFT JOIN (
          SELECT resume_id, string_agg(key || ': ' || value, chr(10) ORDER BY pos) AS resume_text
          FROM entries WHERE trim(value) <> '' GROUP BY resume_id) t ON t.resume_id = r.resume_id""",
    "violations": f"""
        SELECT request_id, pos, name, type,
          CASE WHEN trim(name) = '' THEN 'blank_name'
               WHEN type NOT IN ({_ACCEPTED}) THEN 'bad_type'
               WHEN type = 'select' AND n_options = 0 THEN 'missing_options' END AS reason
        FROM form_fields""",
    "form_verdicts": """
        SELECT q.request_id, count(f.pos) AS n_fields,
          CASE WHEN count(f.pos) = 0 THEN 'no_fields' WHEN count(f.pos) > 50 THEN 'too_many_fields'
               ELSE coalesce(arg_min(f.reason, f.pos) FILTER (WHERE f.reason IS NOT NULL), 'ok') END AS form_verdict,
          CASE WHEN count(f.pos) <= 50 THEN
            CAST(min(f.pos) FILTER (WHERE f.reason IS NOT NULL) AS INT) END AS bad_pos,
          CASE WHEN count(f.pos) <= 50 THEN arg_min(
            CASE f.reason WHEN 'bad_type' THEN f.type WHEN 'missing_options' THEN f.name ELSE '' END, f.pos)
            FILTER (WHERE f.reason IS NOT NULL) END AS bad_subject
        FROM match_requests q LEFT JOIN violations f ON f.request_id = q.request_id
        GROUP BY q.request_id""",
    "redeem_state": """
        SELECT r.request_id, r.user_id, r.code, r.requested_at, c.code_id, c.status, c.total_uses,
          c.used_count, c.expires_at, greatest(c.total_uses - c.used_count, 0) AS room
        FROM redeem_requests r LEFT JOIN activation_codes c ON c.code = r.code""",
    "redeem_marked": """
        SELECT *, code_id IS NOT NULL AND status = 'active'
            AND (expires_at IS NULL OR expires_at >= requested_at)
            AND row_number() OVER (PARTITION BY user_id, code ORDER BY requested_at, request_id) = 1
            AND NOT EXISTS (SELECT 1 FROM user_activations g
                            WHERE g.user_id = redeem_state.user_id AND g.code_id = redeem_state.code_id)
          AS eligible
        FROM redeem_state""",
    "redeem_counted": """
        SELECT *, coalesce(sum(eligible::INT) OVER (PARTITION BY code ORDER BY requested_at, request_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM redeem_marked""",
    "redeemed": """
        SELECT *, CASE WHEN code_id IS NULL THEN 'not_found' WHEN status <> 'active' THEN 'inactive'
            WHEN room > 0 AND before >= room THEN 'inactive'
            WHEN expires_at < requested_at THEN 'expired' WHEN room = 0 THEN 'exhausted'
            WHEN NOT eligible THEN 'duplicate' ELSE 'ok' END AS verdict
        FROM redeem_counted""",
    "quota_events": """
        SELECT user_id, activated_at AS ts, 0 AS kind, activation_id AS id, remaining_uses AS delta FROM user_activations
        UNION ALL SELECT user_id, used_at, 1, use_id, -1 FROM quota_uses""",
    "answers": _answers("model_outputs"),
    "matches": _matches("answers"),
    "match_answers_read": _answers("match_answers"),
    "match_answers_matches": _matches("match_answers_read"),
    "checked": """
        SELECT q.request_id, q.user_id, q.website_url, q.requested_at, v.n_fields, t.resume_text,
          CASE WHEN u.user_id IS NULL THEN 'invalid_credentials' WHEN u.status <> 'active' THEN 'deactivated'
               WHEN v.form_verdict <> 'ok' THEN v.form_verdict
               WHEN t.resume_id IS NULL THEN 'resume_not_found'
               WHEN trim(t.resume_text) = '' THEN 'resume_empty' ELSE 'ok' END AS check_verdict
        FROM match_requests q LEFT JOIN users u ON u.user_id = q.user_id
        JOIN form_verdicts v ON v.request_id = q.request_id
        LEFT JOIN texts t ON t.resume_id = q.resume_id AND t.user_id = q.user_id""",
    "outcomes": """
        SELECT c.*, CASE WHEN check_verdict <> 'ok' THEN check_verdict
            ELSE coalesce(a.answer_verdict, 'api_error') END AS outcome
        FROM checked c LEFT JOIN match_answers_read a ON a.request_id = c.request_id""",
    "match_counts": """
        SELECT request_id, count(*) AS n_valid, count(*) FILTER (WHERE matched_value <> '') AS n_valued
        FROM match_answers_matches GROUP BY request_id""",
    "charge_events": """
        SELECT user_id, activated_at AS ts, 0 AS kind, activation_id AS id, remaining_uses AS delta FROM user_activations
        UNION ALL SELECT user_id, requested_at, 1, request_id, -1 FROM outcomes WHERE outcome = 'ok'""",
    "descriptors": """
        SELECT request_id, pos, '字段名: ' || name
          || CASE WHEN label <> '' THEN ', 标签: ' || label ELSE '' END
          || CASE WHEN placeholder <> '' THEN ', 占位符: ' || placeholder ELSE '' END
          || ', 类型: ' || type
          || CASE WHEN n_options > 0 THEN ', 选项: ["it''s 1", ''option 2'', ''option 3'']' ELSE '' END AS descriptor
        FROM form_fields""",
    "first_registrations": """
        SELECT *, row_number() OVER (PARTITION BY email ORDER BY requested_at, request_id) = 1
            AND email NOT IN (SELECT email FROM users) AS accepted FROM registrations""",
    "email_claims": """
        SELECT p.user_id, p.request_id, p.requested_at, p.email, u.email AS initial, h.user_id AS first_holder
        FROM user_patches p JOIN stored_users u ON u.user_id = p.user_id
        LEFT JOIN stored_users h ON h.email = p.email WHERE p.has_email""",
    # each round judges all claims from the last round's outcomes; far more rounds than chains are long
    "email_rounds": """
        SELECT 0 AS round, *, CAST(NULL AS VARCHAR) AS own, first_holder IS NULL OR first_holder = user_id AS ok FROM email_claims
        UNION ALL
        SELECT round + 1, user_id, request_id, requested_at, email, initial, first_holder, own,
          coalesce(holder, first_holder, -1) IN (-1, user_id) AS ok
        FROM (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY email ORDER BY requested_at, request_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder
              FROM (SELECT round, user_id, request_id, requested_at, event.e AS email, initial, first_holder, own,
                      event.t AS turn, event.p AS probe
              FROM (SELECT m.*, unnest(CASE WHEN ok AND m.email <> m.own
                        THEN [{e: m.email, t: m.user_id, p: true}, {e: m.own, t: -1, p: false}]
                        ELSE [{e: m.email, t: NULL, p: true}] END) AS event
                    FROM (SELECT * EXCLUDE (own), coalesce(last_value(CASE WHEN ok THEN email END IGNORE NULLS) OVER (
                              PARTITION BY user_id ORDER BY requested_at, request_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial) AS own
                          FROM email_rounds WHERE round < 40) m)))
        WHERE probe""",
    "patch_rulings": """
        SELECT p.*, r.own, CASE WHEN p.user_id NOT IN (SELECT user_id FROM stored_users) THEN 'not_found'
            WHEN NOT r.ok THEN 'email_conflict' ELSE 'ok' END AS verdict
        FROM user_patches p LEFT JOIN (SELECT * FROM email_rounds WHERE round = 40) r ON r.request_id = p.request_id""",
    "set_steps": """
        SELECT resume_id, user_id, request_id, requested_at, pos, key, json_extract_string(patch, key) AS value
        FROM (SELECT *, unnest(json_keys(patch)) AS key, unnest(range(len(json_keys(patch)))) AS pos FROM field_edits)""",
}


def _ledger(events: str) -> str:
    running = "PARTITION BY user_id ORDER BY ts, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
        SELECT *, s >= m AS ok, CAST(s - least(m, s) AS BIGINT) AS balance
        FROM (SELECT *, least(0, coalesce(min(s) OVER ({running} 1 PRECEDING), 0)) AS m
              FROM (SELECT *, sum(delta) OVER ({running} CURRENT ROW) AS s FROM {events}))"""


_SHARED["ledger"] = _ledger("quota_events")
_SHARED["charges"] = _ledger("charge_events")
_SHARED["covers"] = """
    SELECT user_id, id AS activation_id,
      sum(delta) OVER (PARTITION BY user_id ORDER BY ts, id) AS upto, delta
    FROM quota_events WHERE kind = 0"""
_SHARED["drawn"] = """
    SELECT u.use_id, u.user_id, c.activation_id
    FROM (SELECT id AS use_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k
          FROM ledger WHERE kind = 1 AND ok) u
    JOIN covers c ON c.user_id = u.user_id AND u.k <= c.upto AND u.k > c.upto - c.delta"""

ORACLE: dict[str, str] = {}
_BODIES: dict[str, str] = {}


def _needed(body: str) -> list[str]:
    """Shared tables the body reads, dependencies first."""
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for token in text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split():
            if token in _SHARED and token != own and token not in order:
                visit(_SHARED[token], token)
                if token not in order:
                    order.append(token)

    visit(body)
    return order


def _add(name: str, body: str) -> None:
    _BODIES[name] = body
    _put(name, {table: _SHARED[table] for table in _needed(body)}, body)


def _put(name: str, tables: dict[str, str], body: str) -> None:
    listed = ",\n".join(f"{table} AS ({text})" for table, text in tables.items())
    ORACLE[name] = f"WITH RECURSIVE {listed}\n{body}" if "email_rounds" in listed else f"WITH {listed}\n{body}"


def _add_gated(name: str, plain: str, requests: str, refused: str = "") -> None:
    """The plain query over the requests that pass the gate when they come, and its rows for the others."""
    body = _BODIES[plain]
    tables = {}
    for table in _needed(f"users deactivations {body}"):
        if table == requests:
            tables["judged"] = f"""
        SELECT q.*, CASE WHEN u.user_id IS NULL THEN 'invalid_credentials'
            WHEN u.status <> 'active' OR EXISTS (SELECT 1 FROM deactivations d
              WHERE d.user_id = q.user_id AND d.requested_at <= q.requested_at) THEN 'deactivated'
            ELSE 'pass' END AS gate
        FROM ({_SHARED[requests]}) q LEFT JOIN users u ON u.user_id = q.user_id"""
            tables[table] = "SELECT * EXCLUDE (gate) FROM judged WHERE gate = 'pass'"
        else:
            tables[table] = _SHARED[table]
    _put(name, tables, f"SELECT * FROM ({body})" + (
        f" UNION ALL BY NAME SELECT {refused}, gate AS verdict FROM judged WHERE gate <> 'pass'" if refused else ""))


# --- scans and sinks
_add("scan_users", "SELECT * FROM users")
_add("scan_resumes", """
    SELECT resume_id, user_id, title, CAST(len(json_keys(fields)) AS INT) AS n_fields,
      json_extract_string(fields, 'email') AS email, updated_seq FROM resumes""")
_add("scan_codes", "SELECT * FROM activation_codes")
_add("scan_grants", "SELECT * FROM user_activations")
_add("scan_usage_logs", "SELECT * FROM usage_logs")
_add("preset_fields", """
    SELECT p.position, p."group", p.key, p.label, p.category, CAST(NULL AS VARCHAR) AS placeholder, p.required,
      count(e.resume_id) AS n_resumes
    FROM preset p LEFT JOIN entries e ON e.key = p.key GROUP BY ALL""")
_add("field_types", """
    SELECT t.type, t.name, t.description, t.name IS NOT NULL AS advertised, count(f.request_id) AS n_fields
    FROM types t LEFT JOIN form_fields f ON f.type = t.type GROUP BY ALL""")
_add("seed_insert", """
    SELECT * FROM users UNION ALL
    SELECT user_id, email, lower(status), created_at, updated_at FROM seed_users
    WHERE email NOT IN (SELECT email FROM users)
    QUALIFY row_number() OVER (PARTITION BY email ORDER BY user_id) = 1""")
_add("append_usage_log", """
    SELECT o.request_id AS log_id, o.user_id,
      CASE WHEN website_url IS NULL OR website_url = '' THEN 'unknown' ELSE website_url END AS website_url,
      CAST(o.n_fields AS INT) AS fields_count, CAST(coalesce(m.n_valid, 0) AS INT) AS success_count,
      o.requested_at AS used_at
    FROM outcomes o LEFT JOIN match_counts m ON m.request_id = o.request_id WHERE o.outcome = 'ok'""")

# --- lookups
_add("lookup_one_or_none", """
    SELECT r.request_id, r.user_id, r.code, r.requested_at, count(c.code_id) AS n_found,
      CASE WHEN count(c.code_id) = 1 THEN min(c.code_id) END AS code_id,
      CASE WHEN count(c.code_id) = 1 THEN min(c.total_uses) END AS total_uses
    FROM redeem_requests r LEFT JOIN activation_codes c ON c.code = r.code GROUP BY ALL""")
_add("owned_resume_lookup", """
    SELECT q.request_id, q.resume_id, q.user_id, r.resume_id IS NOT NULL AS found, r.title AS found_title
    FROM resume_requests q LEFT JOIN resumes r ON r.resume_id = q.resume_id AND r.user_id = q.user_id""")
_add("active_user_gate", """
    SELECT d.*, CASE WHEN u.user_id IS NULL THEN 'invalid_credentials' WHEN u.status = 'active' THEN 'pass'
        ELSE 'deactivated' END AS gate
    FROM deactivations d LEFT JOIN users u ON u.user_id = d.user_id""")
_add("login_gate", """
    SELECT r.request_id, r.email, CASE WHEN u.status = 'active' THEN 'pass' ELSE 'invalid_credentials' END AS gate
    FROM registrations r LEFT JOIN users u ON u.email = r.email""")
_add("user_grants", """
    SELECT * FROM user_activations WHERE user_id IN (SELECT user_id FROM redeem_requests)""")
_add("user_code_grants", """
    SELECT * FROM user_activations g WHERE EXISTS (
      SELECT 1 FROM redeem_state s WHERE s.user_id = g.user_id AND s.code_id = g.code_id)""")
_add("validate_code", """
    SELECT request_id, user_id, code, requested_at, verdict,
      CASE WHEN verdict = 'valid' THEN total_uses - used_count END AS remaining_uses
    FROM (SELECT *, CASE WHEN code_id IS NULL THEN 'not_found' WHEN status <> 'active' THEN 'inactive'
            WHEN expires_at < requested_at THEN 'expired' WHEN used_count >= total_uses THEN 'exhausted'
            ELSE 'valid' END AS verdict FROM redeem_state)""")
_add("validate_form_fields", """
    SELECT request_id, n_fields, form_verdict, bad_pos,
      CASE WHEN bad_subject <> '' THEN bad_subject END AS bad_subject FROM form_verdicts""")
_LENGTH_RULES = [
    ("users", "user_id", "not_null", "user_id IS NULL"),
    ("users", "email", "not_null", "email IS NULL"),
    ("users", "status", "not_null", "status IS NULL"),
    ("users", "email", "max_length_255", "length(email) > 255"),
    ("users", "status", "in_domain", "status NOT IN ('active', 'inactive', 'banned')"),
    *[("activation_codes", c, "not_null", f"{c} IS NULL")
      for c in ("code_id", "code", "total_uses", "used_count", "status")],
    ("activation_codes", "code", "max_length_32", "length(code) > 32"),
    ("activation_codes", "status", "in_domain", "status NOT IN ('active', 'used', 'expired')"),
    *[("resumes", c, "not_null", f"{c} IS NULL") for c in ("resume_id", "user_id", "fields")],
    ("resumes", "title", "max_length_200", "length(title) > 200"),
    *[("user_activations", c, "not_null", f"{c} IS NULL")
      for c in ("activation_id", "user_id", "code_id", "remaining_uses")],
    *[("usage_logs", c, "not_null", f"{c} IS NULL")
      for c in ("log_id", "user_id", "website_url", "fields_count", "success_count")],
    ("usage_logs", "website_url", "max_length_500", "length(website_url) > 500"),
]
_add("check_lengths", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{r}' AS rule, "
    f"count(*) FILTER (WHERE {broken}) AS violations FROM {t}" for t, c, r, broken in _LENGTH_RULES))
_add("search_resumes_by_field", """
    SELECT resume_id, user_id FROM entries WHERE key = 'hobby' AND contains(lower(value), 'src1')""")

# --- joins
_add("requests_with_resume", """
    SELECT q.request_id, q.user_id, q.resume_id, q.website_url, q.requested_at, t.resume_text,
      CASE WHEN t.resume_id IS NULL THEN 'resume_not_found' WHEN trim(t.resume_text) = '' THEN 'resume_empty'
           ELSE 'ok' END AS resume_verdict
    FROM match_requests q LEFT JOIN texts t ON t.resume_id = q.resume_id AND t.user_id = q.user_id""")
_add("redeem_with_code", """
    SELECT request_id, user_id, code, requested_at, code_id, total_uses, used_count, status, expires_at
    FROM redeem_state""")
_add("already_redeemed", """
    SELECT request_id, user_id, code, requested_at, code_id,
      EXISTS (SELECT 1 FROM user_activations g WHERE g.user_id = s.user_id AND g.code_id = s.code_id) AS already_redeemed
    FROM redeem_state s""")
_add("new_emails", "SELECT * FROM registrations WHERE email NOT IN (SELECT email FROM users)")
_add("new_codes", "SELECT * FROM redeem_requests WHERE code NOT IN (SELECT code FROM activation_codes)")
_add("fields_with_preset", """
    SELECT e.resume_id, CAST(e.pos AS INT) AS pos, e.key, e.value, p."group", p.label, p.required
    FROM entries e LEFT JOIN preset p ON p.key = e.key""")
_add("fk_orphans", " UNION ALL ".join(
    f"SELECT '{child}' AS child_table, '{column}' AS fk_column, '{parent}' AS parent_table, count(*) AS orphans "
    f"FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{column} = c.{column})"
    for child, column, parent in (
        ("resumes", "user_id", "users"), ("user_activations", "user_id", "users"),
        ("user_activations", "code_id", "activation_codes"), ("usage_logs", "user_id", "users"))))
_GONE_USER = "user_id NOT IN (SELECT user_id FROM users WHERE status = 'banned')"
_add("cascade_delete", f"""
    SELECT 'resumes' AS child_table, resume_id AS row_id FROM resumes WHERE {_GONE_USER}
    UNION ALL SELECT 'usage_logs', log_id FROM usage_logs WHERE {_GONE_USER}
    UNION ALL SELECT 'user_activations', activation_id FROM user_activations WHERE {_GONE_USER}
      AND code_id NOT IN (SELECT code_id FROM activation_codes WHERE status = 'used')""")

# --- aggregates
_TOTALS = """count({row}) AS total_uses, CAST(coalesce(sum(fields_count), 0) AS BIGINT) AS total_fields,
      CAST(coalesce(sum(success_count), 0) AS BIGINT) AS total_successes"""
_RATED = f"SELECT *, {RATE.format(part='total_successes', whole='total_fields')} AS success_rate"
_add("match_stats", f"""
    {_RATED} FROM (SELECT u.user_id, {_TOTALS.format(row='l.log_id')}
      FROM users u LEFT JOIN usage_logs l ON l.user_id = u.user_id GROUP BY u.user_id)""")
_add("remaining_uses", """
    SELECT u.user_id, CAST(coalesce(sum(remaining_uses), 0) AS BIGINT) AS remaining_uses
    FROM users u LEFT JOIN user_activations g ON g.user_id = u.user_id GROUP BY u.user_id""")
_add("usage_stats", """
    SELECT u.user_id, CAST(coalesce(sum(remaining_uses), 0) AS BIGINT) AS remaining_uses,
      count(g.activation_id) AS total_activations
    FROM users u LEFT JOIN user_activations g ON g.user_id = u.user_id GROUP BY u.user_id""")
_add("resume_count", """
    SELECT u.user_id, count(r.resume_id) AS resume_count
    FROM users u LEFT JOIN resumes r ON r.user_id = u.user_id GROUP BY u.user_id""")
_add("match_summary", f"""
    SELECT *, {RATE.format(part='matched_fields', whole='total_fields')} AS match_rate
    FROM (SELECT a.request_id,
            (SELECT count(*) FROM form_fields f WHERE f.request_id = a.request_id) AS total_fields,
            CAST((SELECT count(*) FROM matches m WHERE m.request_id = a.request_id AND m.matched_value <> '')
              AS INT) AS matched_fields
          FROM answers a WHERE a.answer_verdict = 'ok')""")
_add("preset_coverage", """
    SELECT r.resume_id, p."group", CAST(count(*) AS INT) AS n_preset, CAST(count(e.key) AS INT) AS n_present,
      CAST(count(*) FILTER (WHERE p.required AND e.key IS NULL) AS INT) AS required_missing
    FROM resumes r CROSS JOIN preset p LEFT JOIN entries e ON e.resume_id = r.resume_id AND e.key = p.key
    GROUP BY r.resume_id, p."group" """)

# --- ranking, quotas, codes
_add("resume_page", """
    SELECT * FROM (
      SELECT resume_id, user_id, title, CAST(len(json_keys(fields)) AS INT) AS field_count, updated_seq,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_seq DESC, resume_id) AS INT) AS position
      FROM resumes) WHERE position > 1 AND position <= 4""")
_add("first_available_grant", """
    SELECT user_id, activation_id, code_id, remaining_uses, activated_at, n_available, n_available > 1 AS ambiguous
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY activated_at, activation_id) AS rn,
            count(*) OVER (PARTITION BY user_id) AS n_available
          FROM user_activations WHERE remaining_uses > 0) WHERE rn = 1""")
_REDEEM_VERDICTS = "SELECT request_id, user_id, code, requested_at, code_id, verdict FROM redeemed"
_add("redeem_codes", _REDEEM_VERDICTS)
_add("redeem_codes_grants", """
    SELECT request_id AS activation_id, user_id, code_id, 5 AS remaining_uses, requested_at AS activated_at
    FROM redeemed WHERE verdict = 'ok'""")
_add("redeem_codes_state", """
    SELECT c.code_id, CAST(c.used_count + coalesce(n, 0) AS INT) AS used_count,
      CASE WHEN n > 0 AND c.used_count + n >= c.total_uses THEN 'used' ELSE c.status END AS status
    FROM activation_codes c LEFT JOIN (
      SELECT code_id, count(*) AS n FROM redeemed WHERE verdict = 'ok' GROUP BY code_id) r ON r.code_id = c.code_id""")
_LEDGER = "SELECT id AS use_id, user_id, ts AS used_at, ok, balance FROM ledger WHERE kind = 1"
_add("quota_ledger", _LEDGER)
_add("quota_attribution", "SELECT use_id, user_id, activation_id FROM drawn")
_add("quota_grants_left", """
    SELECT g.activation_id, g.user_id, CAST(g.remaining_uses - coalesce(d.n, 0) AS BIGINT) AS remaining_uses
    FROM user_activations g LEFT JOIN (SELECT activation_id, count(*) AS n FROM drawn GROUP BY activation_id) d
      ON d.activation_id = g.activation_id""")
_add("generate_codes", """
    SELECT batch_id, ordinal, code, total_uses, 0 AS used_count, 'active' AS status,
      TIMESTAMP '2024-01-01 00:00:00' AS created_at,
      TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * expires_in_days AS expires_at
    FROM (SELECT *, array_to_string(list_transform(range(16), lambda i:
              substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
                     1 + CAST('0x' || substr(h, 1 + 4 * i, 4) AS INT) % 36, 1)), '') AS code
          FROM (SELECT *, sha256('demo:' || batch_id || ':' || ordinal) AS h
                FROM (SELECT *, CAST(unnest(range(1, n_codes + 1)) AS INT) AS ordinal
                      FROM code_batches WHERE n_codes <= 100)))
    WHERE code NOT IN (SELECT code FROM activation_codes)
    QUALIFY row_number() OVER (PARTITION BY code ORDER BY batch_id, ordinal) = 1""")

# --- documents
_add("field_count", "SELECT resume_id, CAST(len(json_keys(fields)) AS INT) AS field_count FROM resumes")
_add("resume_text", "SELECT resume_id, resume_text FROM texts")
_add("fields_by_category", f"""
    SELECT g.resume_id, g."group", CAST(count(e.key) AS INT) AS n_members,
      coalesce(string_agg(e.key || ': ' || e.value, chr(10) ORDER BY e.pos) FILTER (WHERE trim(e.value) <> ''), '')
        AS member_text
    FROM (SELECT DISTINCT resume_id, "group" FROM (
            SELECT e.resume_id, p."group" FROM (SELECT DISTINCT resume_id FROM entries) e CROSS JOIN preset p
            UNION ALL SELECT resume_id, {_text(dimensions.OTHER_GROUP)} FROM entries
              WHERE key NOT IN (SELECT key FROM preset))) g
    LEFT JOIN (SELECT e.*, coalesce(p."group", {_text(dimensions.OTHER_GROUP)}) AS own
               FROM entries e LEFT JOIN preset p ON p.key = e.key) e
      ON e.resume_id = g.resume_id AND e.own = g."group"
    GROUP BY g.resume_id, g."group" """)
_add("merge_fields", """
    SELECT resume_id, CAST(row_number() OVER (PARTITION BY resume_id
        ORDER BY old_pos NULLS LAST, ts, request_id, pos) - 1 AS INT) AS pos, key, value
    FROM (SELECT coalesce(e.resume_id, s.resume_id) AS resume_id, coalesce(e.key, s.key) AS key, e.pos AS old_pos,
            s.ts, s.request_id, s.pos, coalesce(s.value, e.value) AS value
          FROM entries e FULL JOIN (
            SELECT s.resume_id, s.user_id, s.key, arg_max(s.value, (s.requested_at, s.request_id)) AS value,
              min((s.requested_at, s.request_id, s.pos)) AS first_step, min(s.requested_at) AS ts,
              arg_min(s.request_id, (s.requested_at, s.request_id)) AS request_id,
              arg_min(s.pos, (s.requested_at, s.request_id)) AS pos
            FROM set_steps s JOIN resumes r ON r.resume_id = s.resume_id AND r.user_id = s.user_id
            GROUP BY s.resume_id, s.user_id, s.key) s ON s.resume_id = e.resume_id AND s.key = e.key)""")
_add("delete_field", """
    SELECT resume_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY pos) - 1 AS INT) AS pos, key, value
    FROM entries e WHERE NOT EXISTS (SELECT 1 FROM field_edits d
      WHERE d.resume_id = e.resume_id AND d.user_id = e.user_id AND d.field_key = e.key)""")
_add("merge_fields_verdicts", """
    SELECT d.request_id, CASE WHEN d.patch = '{}' THEN 'empty_patch' WHEN r.resume_id IS NULL THEN 'not_found'
        ELSE 'ok' END AS verdict
    FROM field_edits d LEFT JOIN resumes r ON r.resume_id = d.resume_id AND r.user_id = d.user_id""")
_add("field_descriptors", "SELECT request_id, CAST(pos AS INT) AS pos, descriptor FROM descriptors")

# --- prompts and answers
_HEAD, _REST = PROMPT_TEMPLATE.split("{resume_text}")
_MIDDLE, _TAIL = _REST.split("{fields}")
_add("build_prompts", f"""
    SELECT c.request_id, {_text(_HEAD)} || c.resume_text || {_text(_MIDDLE)} || d.lines || {_text(_TAIL)} AS prompt
    FROM checked c JOIN (
      SELECT request_id, string_agg(pos || '. ' || descriptor, chr(10) ORDER BY pos) AS lines
      FROM descriptors GROUP BY request_id) d ON d.request_id = c.request_id
    WHERE c.check_verdict = 'ok'""")
_add("extract_json_array", "SELECT request_id, answer_verdict FROM answers")
_MATCH_COLUMNS = "request_id, CAST(pos AS INT) AS pos, field_name, field_type, matched_value"
_add("normalise_matches", f"SELECT {_MATCH_COLUMNS} FROM matches")
_add("match_forms", f"""
    SELECT *, {RATE.format(part='matched_fields', whole='total_fields')} AS match_rate
    FROM (SELECT o.request_id, o.user_id, o.outcome, o.n_fields AS total_fields,
            CAST(CASE WHEN o.outcome = 'ok' THEN coalesce(m.n_valued, 0) ELSE 0 END AS INT) AS matched_fields,
            CAST(CASE WHEN o.outcome = 'ok' THEN coalesce(m.n_valid, 0) ELSE 0 END AS INT) AS success_count,
            coalesce(l.ok, FALSE) AS charged
          FROM outcomes o LEFT JOIN match_counts m ON m.request_id = o.request_id
          LEFT JOIN charges l ON l.kind = 1 AND l.id = o.request_id)""")
_add("match_forms_matches", f"""
    SELECT {_MATCH_COLUMNS} FROM match_answers_matches
    WHERE request_id IN (SELECT request_id FROM outcomes WHERE outcome = 'ok')""")

# --- state transitions
_add("register_users", """
    SELECT request_id, email, password_hash, requested_at,
      CASE WHEN accepted THEN 'registered' ELSE 'email_exists' END AS verdict FROM first_registrations""")
_add("register_users_rows", """
    SELECT request_id AS user_id, email, password_hash, 'active' AS status, requested_at AS created_at,
      requested_at AS updated_at FROM first_registrations WHERE accepted""")
_add("update_users_requests", "SELECT request_id, user_id, verdict FROM patch_rulings")
_add("update_users", """
    SELECT u.user_id, coalesce(e.email, u.email) AS email, coalesce(d.password_hash, u.password_hash) AS password_hash,
      coalesce(c.at, u.updated_at) AS updated_at
    FROM stored_users u
    LEFT JOIN (SELECT user_id, arg_max(email, (requested_at, request_id)) AS email FROM patch_rulings
               WHERE verdict = 'ok' AND has_email GROUP BY user_id) e ON e.user_id = u.user_id
    LEFT JOIN (SELECT user_id, arg_max(password_hash, (requested_at, request_id)) AS password_hash FROM patch_rulings
               WHERE verdict = 'ok' AND has_password GROUP BY user_id) d ON d.user_id = u.user_id
    LEFT JOIN (SELECT user_id, max(requested_at) AS at FROM patch_rulings
               WHERE verdict = 'ok' AND (has_password OR (has_email AND email <> own)) GROUP BY user_id) c ON c.user_id = u.user_id""")
_add("update_users_verdicts", """
    SELECT user_id, CASE WHEN bool_or(verdict = 'not_found') THEN 'not_found'
        WHEN bool_or(verdict = 'email_conflict') THEN 'email_conflict' ELSE 'ok' END AS verdict
    FROM patch_rulings GROUP BY user_id""")
_add("deactivate_users", """
    SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM deactivations) THEN 'inactive' ELSE status END AS status
    FROM users""")
_add("deactivate_users_verdicts", """
    SELECT *, CASE WHEN user_id IN (SELECT user_id FROM users) THEN 'ok' ELSE 'not_found' END AS verdict
    FROM deactivations""")
_add("touch_updated_at", """
    SELECT u.user_id, u.created_at,
      CASE WHEN u.status = 'inactive' THEN u.updated_at
           ELSE coalesce((SELECT min(requested_at) FROM deactivations d WHERE d.user_id = u.user_id), u.updated_at)
      END AS updated_at
    FROM users u""")
_REQUEST_TEXT = """'name: ' || json_extract_string({0}.fields, 'name') || chr(10) ||
      'goal: ' || json_extract_string({0}.fields, 'goal')"""
_add("create_resumes", f"""
    SELECT r.resume_id, r.user_id, r.title, t.resume_text, CAST(NULL AS TIMESTAMP) AS updated_at
    FROM resumes r JOIN texts t ON t.resume_id = r.resume_id
    UNION ALL SELECT q.request_id + 1000000000, q.user_id, q.title, {_REQUEST_TEXT.format('q')}, q.requested_at
    FROM resume_requests q""")
_add("update_resumes", f"""
    SELECT r.resume_id, r.user_id, CASE WHEN t.request_id IS NOT NULL THEN t.title ELSE r.title END AS title,
      CASE WHEN f.request_id IS NOT NULL THEN {_REQUEST_TEXT.format('f')} ELSE x.resume_text END AS resume_text
    FROM resumes r JOIN texts x ON x.resume_id = r.resume_id
    LEFT JOIN (SELECT * FROM resume_requests WHERE has_title QUALIFY row_number() OVER (
        PARTITION BY resume_id, user_id ORDER BY requested_at DESC, request_id DESC) = 1) t
      ON t.resume_id = r.resume_id AND t.user_id = r.user_id
    LEFT JOIN (SELECT * FROM resume_requests WHERE has_fields QUALIFY row_number() OVER (
        PARTITION BY resume_id, user_id ORDER BY requested_at DESC, request_id DESC) = 1) f
      ON f.resume_id = r.resume_id AND f.user_id = r.user_id""")
_OWNS = "EXISTS (SELECT 1 FROM resumes r WHERE r.resume_id = q.resume_id AND r.user_id = q.user_id)"
_add("update_resumes_verdicts", f"""
    SELECT request_id, CASE WHEN {_OWNS} THEN 'ok' ELSE 'not_found' END AS verdict FROM resume_requests q""")
_add("delete_resumes", """
    SELECT resume_id, user_id FROM resumes r WHERE NOT EXISTS (SELECT 1 FROM resume_requests q
      WHERE q.resume_id = r.resume_id AND q.user_id = r.user_id)""")
_add("delete_resumes_verdicts", f"""
    SELECT request_id, CASE WHEN {_OWNS} AND row_number() OVER (
        PARTITION BY resume_id, user_id ORDER BY requested_at, request_id) = 1 THEN 'ok' ELSE 'not_found' END AS verdict
    FROM resume_requests q""")
_add("migrate_resumes", """
    SELECT 'plain' AS mode, resume_id, user_id, CAST(NULL AS VARCHAR) AS title, '' AS resume_text FROM legacy_resumes
    UNION ALL SELECT 'backfill', resume_id, user_id, NULL,
      'name: ' || json_extract_string(personal_info, 'name') || chr(10) || 'lang: ' ||
      coalesce(json_extract_string(skills, 'lang'), json_extract_string(personal_info, 'lang')) ||
      coalesce(chr(10) || 'degree: ' || json_extract_string(education, 'degree'), '') ||
      coalesce(chr(10) || 'work_years: ' || json_extract_string(experience, 'work_years'), '')
    FROM legacy_resumes""")
_add("migrate_timestamps", "SELECT log_id, used_at FROM usage_logs")

# --- streams: the same answer as the batch once everything has arrived
_add("stream_match_stats", f"""
    {_RATED} FROM (SELECT user_id, {_TOTALS.format(row='*')} FROM usage_logs GROUP BY user_id)""")
_add("stream_daily_usage", f"""
    SELECT CAST(used_at AS DATE) AS day, {_TOTALS.format(row='*')}
    FROM usage_logs GROUP BY CAST(used_at AS DATE)""")
_add("stream_extract_matches", f"SELECT {_MATCH_COLUMNS} FROM matches")
_add("stream_quota_ledger", _LEDGER)
_add("stream_redeem", _REDEEM_VERDICTS)
_add("stream_quota_ledger_shuffled", "SELECT *, false AS late FROM (" + _LEDGER + ")")
# a tenth of the requests arrives once the watermark stands at the last of the others before the cut
_BEHIND = """request_id % 10 = 7 AND requested_at <= (SELECT max(requested_at) FROM redeem_requests
      WHERE request_id % 10 <> 7 AND requested_at < TIMESTAMP '1996-01-01 00:00:00')"""
_SHARED["late_requests"] = f"SELECT * FROM redeem_requests WHERE {_BEHIND}"
_SHARED["punctual_requests"] = "SELECT * FROM redeem_requests WHERE request_id NOT IN (SELECT request_id FROM late_requests)"
for _view in ("state", "marked", "counted"):
    _SHARED[f"punctual_{_view}"] = _SHARED[f"redeem_{_view}"].replace("redeem_", "punctual_")
_SHARED["punctual_redeemed"] = _SHARED["redeemed"].replace("redeem_", "punctual_")
_add("stream_redeem_late", """
    SELECT request_id, user_id, code, requested_at, code_id, verdict FROM punctual_redeemed
    UNION ALL SELECT request_id, user_id, code, requested_at, NULL, 'late' FROM late_requests""")

# --- merges and deletes in turn: the document's own entries are the first steps
_SHARED["mixed_steps"] = """
        SELECT resume_id, user_id, TIMESTAMP '0001-01-01 00:00:00' AS ts, -1 AS request_id, pos, key, value, true AS sets, true AS own FROM entries
        UNION ALL SELECT resume_id, user_id, requested_at, request_id, pos, key, value, true, false FROM set_steps WHERE request_id % 3 <> 1
        UNION ALL SELECT resume_id, user_id, requested_at, request_id, 0, field_key, NULL, false, false FROM field_edits WHERE request_id % 3 = 1"""
_SHARED["mixed_marked"] = """
        SELECT *, coalesce(lag(sets) OVER w, false) AS there FROM mixed_steps
        WINDOW w AS (PARTITION BY resume_id, user_id, key ORDER BY ts, request_id, pos)"""
_SHARED["mixed_keys"] = """
        SELECT resume_id, user_id, key, arg_max(sets, (ts, request_id, pos)) AS present,
          arg_max(coalesce(value, ''), (ts, request_id, pos)) AS value,
          max((ts, request_id, pos)) FILTER (WHERE sets AND NOT there) AS place,
          max(ts) FILTER (WHERE NOT own AND (sets OR there)) AS changed
        FROM mixed_marked GROUP BY resume_id, user_id, key"""
_add("edit_fields_mixed", """
    SELECT r.resume_id, coalesce(string_agg(m.key || ': ' || m.value, chr(10) ORDER BY m.place)
        FILTER (WHERE m.present AND trim(m.value) <> ''), '') AS resume_text, max(m.changed) AS updated_at
    FROM resumes r LEFT JOIN mixed_keys m ON m.resume_id = r.resume_id AND m.user_id = r.user_id GROUP BY r.resume_id""")
_add("edit_fields_mixed_verdicts", """
    SELECT d.request_id, CASE WHEN d.request_id % 3 <> 1 AND d.patch = '{}' THEN 'empty_patch'
        WHEN r.resume_id IS NULL THEN 'not_found' ELSE 'ok' END AS verdict
    FROM field_edits d LEFT JOIN resumes r ON r.resume_id = d.resume_id AND r.user_id = d.user_id""")

# --- changes behind the active-user gate
_add("gate_as_of", """
    SELECT r.*, CASE WHEN u.user_id IS NULL THEN 'invalid_credentials'
        WHEN u.status <> 'active' OR EXISTS (SELECT 1 FROM deactivations d
          WHERE d.user_id = r.user_id AND d.requested_at <= r.requested_at) THEN 'deactivated' ELSE 'pass' END AS gate
    FROM redeem_requests r LEFT JOIN users u ON u.user_id = r.user_id""")
_add_gated("gated_redeem", "redeem_codes", "redeem_requests", "request_id, user_id, code, requested_at")
_add_gated("gated_redeem_state", "redeem_codes_state", "redeem_requests")
_add_gated("gated_update_users", "update_users", "user_patches")
_add_gated("gated_update_users_requests", "update_users_requests", "user_patches", "request_id, user_id")
_add_gated("gated_delete_resumes", "delete_resumes", "resume_requests")
_add_gated("gated_delete_resumes_verdicts", "delete_resumes_verdicts", "resume_requests", "request_id")

# --- stored documents, broken ones in quarantine
_BROKEN = ("fields IS NOT NULL AND coalesce(CASE WHEN json_valid(fields) THEN json_type(fields) END, '') "
           "NOT IN ('OBJECT', 'NULL')")


def _add_stored(name: str, plain: str, body: str) -> None:
    """The plain query over the sound documents as ``edited``, beside the stored ones."""
    tables = {table: _SHARED[table] for table in _needed(f"stored_resumes {_BODIES[plain]}")}
    tables["resumes"] = f"SELECT * FROM stored_resumes WHERE NOT ({_BROKEN})"
    _put(name, tables, body.format(edited=f"({_BODIES[plain]})", broken=f"(SELECT * FROM stored_resumes WHERE {_BROKEN})"))


_add_stored("edit_stored_resumes", "edit_fields_mixed", """
    SELECT resume_id, false AS broken, resume_text AS content FROM {edited}
    UNION ALL SELECT resume_id, true, fields FROM {broken}""")
_add_stored("edit_stored_verdicts", "edit_fields_mixed_verdicts", """
    SELECT v.request_id, CASE WHEN v.verdict = 'not_found' AND EXISTS (SELECT 1 FROM {broken} b
        JOIN field_edits d ON d.resume_id = b.resume_id AND d.user_id = b.user_id WHERE d.request_id = v.request_id)
      THEN 'corrupt_document' ELSE v.verdict END AS verdict FROM {edited} v""")
_add("check_documents", f"""
    SELECT 'resumes' AS table_name, 'fields' AS column_name, 'json_object' AS rule, count(*) FILTER (WHERE {_BROKEN}) AS violations
    FROM stored_resumes""")
