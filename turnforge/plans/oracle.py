"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code: long-form joins and ``string_agg``
instead of arrays, closed forms instead of parsers (e.g. which fixture rows
are malformed is decided from the fixture formula, not by parsing).
"""

from __future__ import annotations

from turnforge import constants as K
from turnforge import prompts as P


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


LANGS_SQL = "[" + ", ".join(q(x) for x in K.LANGUAGES) + "]"
NL = "chr(10)"
TOKEN = q(r"\p{Han}|[^\P{L}\p{Han}]+")
END = q(K.END_MARKER)

FIXTURE_CTES = f"""
fx_msgs AS (
  SELECT conv_id, turn, role, text AS content,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos
  FROM conversations WHERE role IN ('user', 'assistant')
),
fx_dial AS (
  SELECT conv_id, conv_id AS row_idx, lang, seed_scene,
         seed_scene || {q(P.LANG_LINE)} || lang AS scene
  FROM (
    SELECT conv_id, {LANGS_SQL}[conv_id % 6 + 1] AS lang,
           coalesce(max(CASE WHEN role = 'system' THEN text END), 'Scene ' || conv_id) AS seed_scene
    FROM conversations GROUP BY conv_id)
),
fx_att0 AS (
  SELECT CASE WHEN pos = 0 THEN 'starter' ELSE 'turn' END AS flow, conv_id, pos, content AS text,
         {LANGS_SQL}[conv_id % 6 + 1] AS lang,
         unnest(generate_series(0, CASE WHEN pos = 0 THEN {K.MAX_STARTER_ROUNDS} ELSE {K.MAX_TURN_ROUNDS} END)) AS attempt
  FROM fx_msgs WHERE role = 'user'
),
fx_att1 AS (
  SELECT flow, conv_id, pos, CAST(attempt AS BIGINT) AS attempt, lang,
         CASE WHEN flow = 'starter' THEN 'r1-fx-' || lang || '-m1-' || conv_id
              ELSE lang || '_r1_m1_turn-' || pos || '-' || conv_id END AS custom_id,
         CASE (conv_id * 7 + pos * 3) % 20
              WHEN 0 THEN '"' || text || '"'
              WHEN 1 THEN 'user: ' || text
              WHEN 2 THEN '"user: ' || text || '"'
              WHEN 3 THEN 'END_OF_DIALOGUE'
              WHEN 4 THEN text || ' PersonY'
              WHEN 5 THEN text || ' user: '
              ELSE text END AS base,
         CASE (conv_id * 11 + pos * 5) % 23
              WHEN 0 THEN NULL
              WHEN 1 THEN 'n/a'
              WHEN 2 THEN 'Not sure'
              WHEN 3 THEN 'No. Yes, but too long'
              WHEN 4 THEN 'No. exhausted ' || attempt
              ELSE CASE WHEN (conv_id * 31 + pos * 17 + attempt * 7) % 10 < 4 THEN 'No. retry ' || attempt
                        ELSE 'Yes.' END END AS verdict
  FROM fx_att0
),
fx_attempts AS (
  SELECT flow, conv_id, pos, attempt, lang, custom_id, verdict,
         CASE WHEN attempt > 0 THEN base || ' [retry ' || attempt || ']' ELSE base END AS content,
         CASE WHEN flow = 'starter' THEN NOT coalesce(contains(verdict, 'No'), true)
              ELSE coalesce(contains(verdict, 'Yes'), false) END AS accepted
  FROM fx_att1
),
fx_win AS (
  SELECT custom_id, flow, conv_id, pos, min(attempt) FILTER (WHERE accepted) AS a_star
  FROM fx_attempts GROUP BY custom_id, flow, conv_id, pos
),
fx_fold AS (
  SELECT w.custom_id, w.flow, w.conv_id, w.pos, w.a_star AS winning_attempt,
         CASE WHEN w.a_star IS NOT NULL THEN aw.content
              WHEN w.flow = 'starter' THEN a0.content ELSE {END} END AS final_content
  FROM fx_win w
  JOIN fx_attempts a0 ON a0.custom_id = w.custom_id AND a0.attempt = 0
  LEFT JOIN fx_attempts aw ON aw.custom_id = w.custom_id AND aw.attempt = w.a_star
),
fx_comp AS (
  SELECT custom_id, conv_id, pos, lang, attempt, (conv_id + pos + attempt) % 17 AS e,
         CASE WHEN (conv_id + pos + attempt) % 17 IN (0, 1, 3) THEN NULL ELSE content END AS content,
         CASE WHEN (conv_id + pos + attempt) % 17 = 0 THEN 'timeout; rate limit'
              WHEN (conv_id + pos + attempt) % 17 = 1 THEN 'malformed'
              WHEN (conv_id + pos + attempt) % 17 = 3 THEN 'boom; again' END AS error
  FROM fx_attempts
),
fx_rules AS (
  SELECT m.conv_id, m.pos, m.role,
         CASE WHEN m.conv_id % 10 = 7 AND m.pos = 2 AND d.content IS NOT NULL THEN d.content
              WHEN m.conv_id % 9 = 2 AND m.pos = 0 THEN m.content || ' PersonY'
              ELSE m.content END AS content
  FROM fx_msgs m LEFT JOIN fx_msgs d ON d.conv_id = m.conv_id + 1 AND d.pos = 0
  WHERE NOT (m.conv_id % 10 = 3 AND m.pos = 1)
),
fx_tok AS (
  SELECT conv_id, pos, role, list_distinct(regexp_extract_all(lower(content), {TOKEN})) AS toks
  FROM fx_rules
),
fx_pairsim AS (
  SELECT b.conv_id, b.pos, b.role AS role_b, a.role AS role_a,
         CASE WHEN len(a.toks) + len(b.toks) = 0 THEN 0.0
              ELSE len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))
         END AS jac
  FROM fx_tok b JOIN fx_tok a ON a.conv_id = b.conv_id AND a.pos < b.pos
),
fx_count AS (
  SELECT lang, tok, count(*) AS cnt FROM (SELECT lang, unnest(regexp_extract_all(lower(text), {TOKEN})) AS tok FROM documents) GROUP BY lang, tok
),
fx_profile AS (
  SELECT tok, lang FROM (
    SELECT c.tok, c.lang, row_number() OVER (PARTITION BY c.tok ORDER BY c.cnt / t.total DESC, c.lang ASC) AS r
    FROM fx_count c JOIN (SELECT lang, sum(cnt)::BIGINT AS total FROM fx_count GROUP BY lang) t USING (lang))
  WHERE r = 1
),
fx_detect AS (
  SELECT r.conv_id, r.pos, r.role, coalesce(b.lang, 'unknown') AS detected
  FROM fx_rules r LEFT JOIN (
    SELECT conv_id, pos, lang FROM (
      SELECT conv_id, pos, lang, row_number() OVER (PARTITION BY conv_id, pos ORDER BY h DESC, lang ASC) AS rk
      FROM (SELECT t.conv_id, t.pos, p.lang, count(*) AS h
            FROM (SELECT conv_id, pos, unnest(regexp_extract_all(lower(content), {TOKEN})) AS tok FROM fx_rules) t
            JOIN fx_profile p ON p.tok = t.tok GROUP BY t.conv_id, t.pos, p.lang))
    WHERE rk = 1) b ON b.conv_id = r.conv_id AND b.pos = r.pos
),
fx_lang AS (
  SELECT d.conv_id, d.pos, d.detected AS metric, coalesce(d.detected <> f.first_lang, false) AS flag
  FROM fx_detect d LEFT JOIN (
    SELECT conv_id, arg_min(detected, pos) AS first_lang FROM fx_detect WHERE role = 'user' GROUP BY conv_id
  ) f ON f.conv_id = d.conv_id
),
fx_role AS (
  SELECT r.conv_id, r.pos,
         CAST(coalesce(r.role = lag(r.role) OVER (PARTITION BY r.conv_id ORDER BY r.pos), false) AS BIGINT)
         + CAST(regexp_matches(r.content, '(?i)(user|assistant):') AS BIGINT)
         + CAST(coalesce((SELECT max(s.jac) FROM fx_pairsim s
                           WHERE s.conv_id = r.conv_id AND s.pos = r.pos AND s.role_a = 'assistant') >= 0.5, false) AS BIGINT)
         AS metric
  FROM fx_rules r
),
fx_judge AS (
  SELECT doc_id, 'eval-' || doc_id AS custom_id, toxic, quality, doc_id % 13 AS k,
         CASE WHEN doc_id % 13 = 3 THEN 9 ELSE 1 + 3 * quality + doc_id % 2 END AS rating
  FROM labels
),
fx_parsed AS (
  SELECT j.doc_id, j.custom_id, i.issue,
         CAST(CASE WHEN j.k IN (1, 2) THEN NULL
                   WHEN i.issue = 'unsafe' THEN j.toxic
                   WHEN i.issue = {q(K.RATING_KEY)} THEN j.rating END AS BIGINT) AS label
  FROM fx_judge j CROSS JOIN (SELECT unnest({"[" + ", ".join(q(x) for x in K.ISSUE_KEYS + [K.RATING_KEY]) + "]"}) AS issue) i
),
fx_parsed2 AS (
  SELECT doc_id, custom_id, issue, label,
         coalesce(CASE WHEN issue = {q(K.RATING_KEY)} THEN label BETWEEN 1 AND 5 ELSE label IN (0, 1) END, false) AS is_valid
  FROM fx_parsed
),
fx_ledger0 AS (
  SELECT task, rn, event_type IN ('click', 'purchase') AS ok,
         CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'view' THEN 'api' WHEN 'signup' THEN 'other' END AS kind,
         CASE event_type WHEN 'error' THEN 'Rate limit reached, retry later' WHEN 'view' THEN 'The server had an error'
              WHEN 'signup' THEN 'Cannot connect to host api.x.com: rate limit?' END AS message
  FROM (SELECT user_id * 10 + event_id % 10 AS task, event_type,
               row_number() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY ts, event_id) AS rn
        FROM events)
  WHERE rn <= {K.MAX_TRIES}
),
fx_ledger AS (
  SELECT l.task,
         CAST(coalesce(s.fs, count(*)) AS BIGINT) AS tries,
         CASE WHEN s.fs IS NOT NULL THEN 'succeeded' WHEN count(*) >= {K.MAX_TRIES} THEN 'failed' ELSE 'in_progress' END AS status,
         CAST(count(*) FILTER (WHERE l.rn < coalesce(s.fs, {K.MAX_TRIES + 1})) AS BIGINT) AS n_errors,
         coalesce(string_agg(l.kind, ',' ORDER BY l.rn) FILTER (WHERE l.rn < coalesce(s.fs, {K.MAX_TRIES + 1})), '') AS errors,
         coalesce(string_agg(l.message, '; ' ORDER BY l.rn) FILTER (WHERE l.rn < coalesce(s.fs, {K.MAX_TRIES + 1})), '') AS messages
  FROM fx_ledger0 l JOIN (SELECT task, min(rn) FILTER (WHERE ok) AS fs FROM fx_ledger0 GROUP BY task) s USING (task)
  GROUP BY l.task, s.fs
)
"""


def hist(cond: str, newline: str, sep: str = NL, terminate: bool = False) -> str:
    """Correlated history text over ``fx_msgs h`` (rows matching ``cond``)."""
    content = f"replace(h.content, {NL}, '')" if newline == "delete" else "h.content"
    line = f"h.role || ': ' || {content}"
    if terminate:
        return f"coalesce((SELECT string_agg({line} || {sep}, '' ORDER BY h.pos) FROM fx_msgs h WHERE {cond}), '')"
    return f"coalesce((SELECT string_agg({line}, {sep} ORDER BY h.pos) FROM fx_msgs h WHERE {cond}), '')"


USER_PROMPT_BASE = (f"{q(P.SCENE_HEAD)} || d.scene || {NL} || {q(P.HISTORY_HEAD)} || "
                    f"{hist('h.conv_id = u.conv_id AND h.pos < u.pos', 'delete')} || {NL} || {NL}")

ORACLE: dict[str, str] = {}

ORACLE["dialogue_table"] = f"""
SELECT d.conv_id, CAST(count(m.pos) AS BIGINT) AS n_msgs,
       CAST(count(*) FILTER (WHERE m.role = 'user') AS BIGINT) AS n_user,
       CAST(count(*) FILTER (WHERE m.role = 'assistant') AS BIGINT) AS n_assistant,
       coalesce(string_agg(m.role || ': ' || replace(m.content, {NL}, ''), {NL} ORDER BY m.pos), '') AS transcript
FROM fx_dial d LEFT JOIN fx_msgs m USING (conv_id) GROUP BY d.conv_id
"""

ORACLE["custom_ids"] = """
SELECT conv_id, lang || '_r1_chat-x-4_turn-0-' || conv_id AS custom_id, 'chat-x-4' AS model_short,
       TRY_CAST(string_split(lang || '_r1_chat-x-4_turn-0-' || conv_id, '-')[-1] AS BIGINT) AS decoded_idx
FROM fx_dial
"""

ORACLE["starter_requests"] = f"""
SELECT 'r1-docs-' || lang || '-m1-' || row_idx AS custom_id, row_idx, lang,
       text || {q(P.LANG_LINE)} || lang AS user_content,
       CAST({K.STARTER_PARAMS['temperature']} AS DOUBLE) AS temperature,
       CAST({K.STARTER_PARAMS['max_tokens']} AS BIGINT) AS max_tokens
FROM (SELECT doc_id, lang, text, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS row_idx
      FROM documents)
"""

ORACLE["request_jsonl"] = f"""
SELECT 'r1-docs-' || lang || '-m1-' || row_idx AS custom_id, 'POST' AS method, {q(K.CHAT_URL)} AS url,
       'm1' AS model, CAST(2 AS BIGINT) AS n_messages,
       text || {q(P.LANG_LINE)} || lang AS user_content,
       CAST({K.STARTER_PARAMS['temperature']} AS DOUBLE) AS temperature,
       CAST({K.STARTER_PARAMS['top_p']} AS DOUBLE) AS top_p,
       CAST({K.STARTER_PARAMS['max_tokens']} AS BIGINT) AS max_tokens
FROM (SELECT doc_id, lang, text, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS row_idx
      FROM documents)
"""

ORACLE["starter_verdict_requests"] = f"""
SELECT custom_id, a.attempt, content AS user_content, CAST({K.STARTER_VERDICT_PARAMS['temperature']} AS DOUBLE) AS temperature,
       CAST({K.STARTER_VERDICT_PARAMS['max_tokens']} AS BIGINT) AS max_tokens
FROM fx_attempts a JOIN fx_win w USING (custom_id) WHERE a.flow = 'starter' AND (w.a_star IS NULL OR a.attempt <= w.a_star)
"""

ORACLE["seed_scenes"] = """
SELECT CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS scene_id, text AS scene FROM documents
"""

# Sampling values of the turn requests, by hand.
TURN_SAMPLING = ("0.9::DOUBLE AS temperature, 0.95::DOUBLE AS top_p, 1.0::DOUBLE AS frequency_penalty, "
                 "0.6::DOUBLE AS presence_penalty, 512::BIGINT AS max_tokens")

ORACLE["user_turn_requests"] = f"""
SELECT d.lang || '_r1_m1_turn-' || u.pos || '-' || u.conv_id AS custom_id,
       {USER_PROMPT_BASE} || {q(P.DEFAULT_PROMPTS['user_turn_cue'])} AS prompt, {TURN_SAMPLING}
FROM fx_msgs u JOIN fx_dial d USING (conv_id)
WHERE u.role = 'user' AND u.pos > 0 AND u.conv_id % 6 <> 5
"""

ORACLE["assistant_turn_requests"] = f"""
SELECT d.lang || '_r1_m2_turn-' || u.pos || '-' || u.conv_id AS custom_id, CAST(0 AS BIGINT) AS msg_pos,
       'system' AS role, {q(P.DEFAULT_PROMPTS['assistant_system'])} AS content, {TURN_SAMPLING}
FROM fx_msgs u JOIN fx_dial d USING (conv_id) WHERE u.role = 'assistant'
UNION ALL
SELECT d.lang || '_r1_m2_turn-' || u.pos || '-' || u.conv_id, h.pos + 1, h.role, h.content, {TURN_SAMPLING}
FROM fx_msgs u JOIN fx_dial d USING (conv_id) JOIN fx_msgs h ON h.conv_id = u.conv_id AND h.pos < u.pos
WHERE u.role = 'assistant'
"""

ORACLE["typed_parts"] = f"""
SELECT custom_id, msg_pos, 'text' AS part_type, content AS part_text FROM (
{ORACLE['assistant_turn_requests']}
) x WHERE CAST(string_split(custom_id, '-')[-1] AS BIGINT) % 2 = 0
"""

ORACLE["turn_verdict_requests"] = f"""
SELECT u.custom_id, u.attempt, 0.1::DOUBLE AS temperature, 0.95::DOUBLE AS top_p, 1.0::DOUBLE AS frequency_penalty,
       0.6::DOUBLE AS presence_penalty, 512::BIGINT AS max_tokens,
       {q(P.SCENE_HEAD)} || d.scene || {NL} || {NL} || {q(P.HISTORY_HEAD)}
       || {hist('h.conv_id = u.conv_id AND h.pos < u.pos', 'keep', terminate=True)}
       || {q(P.RESPONSE_HEAD)} || 'user: ' || u.content AS prompt
FROM fx_attempts u JOIN fx_dial d USING (conv_id) JOIN fx_win w ON w.custom_id = u.custom_id
WHERE u.flow = 'turn' AND (w.a_star IS NULL OR u.attempt <= w.a_star)
"""

ORACLE["dialogue_eval_requests"] = f"""
SELECT 'dialogues/' || d.lang || '/user-a_bot-1-' || d.conv_id AS custom_id,
       {q(P.DIALOGUE_HEAD)} || {hist('h.conv_id = d.conv_id', 'keep')} AS prompt,
       0.0::DOUBLE AS temperature, 1.0::DOUBLE AS top_p, 2048::BIGINT AS max_tokens, 'json_object' AS response_format
FROM fx_dial d
"""

ORACLE["regen_requests"] = f"""
SELECT r.custom_id, r.attempt,
       {USER_PROMPT_BASE}
       || string_agg({q(P.REGEN_BLOCK_HEAD)} || coalesce(k.content, '') || {q(P.REGEN_BLOCK_REASON)}
                     || coalesce(k.verdict, '') || {NL}, '' ORDER BY k.attempt) AS prompt
FROM fx_attempts r
JOIN fx_win w ON w.custom_id = r.custom_id
JOIN fx_msgs u ON u.conv_id = r.conv_id AND u.pos = r.pos
JOIN fx_dial d ON d.conv_id = r.conv_id
JOIN fx_attempts k ON k.custom_id = r.custom_id AND k.attempt < r.attempt
WHERE r.flow = 'turn' AND r.attempt >= 1 AND r.attempt <= coalesce(w.a_star, {K.MAX_TURN_ROUNDS})
  AND r.conv_id % 6 <> 5
GROUP BY r.custom_id, r.attempt, d.scene, u.conv_id, u.pos
"""

ORACLE["starter_regen"] = f"""
SELECT r.custom_id, r.attempt, d.scene AS user_content
FROM fx_attempts r JOIN fx_win w ON w.custom_id = r.custom_id JOIN fx_dial d ON d.conv_id = r.conv_id
WHERE r.flow = 'starter' AND r.attempt >= 1 AND r.attempt <= coalesce(w.a_star, {K.MAX_STARTER_ROUNDS})
"""

ORACLE["completion_extract"] = """
SELECT CASE WHEN e = 1 THEN NULL ELSE custom_id END AS custom_id, attempt, content, error, content IS NULL AS is_error FROM fx_comp
"""

ORACLE["completion_files"] = """
SELECT custom_id, attempt, content, error FROM fx_comp WHERE e <> 1
"""

ORACLE["replay_complete"] = """
SELECT a.custom_id, a.attempt, c.content, CASE WHEN c.custom_id IS NULL THEN 'missing' ELSE c.error END AS error
FROM fx_attempts a LEFT JOIN fx_comp c ON c.custom_id = a.custom_id AND c.attempt = a.attempt AND a.attempt <= 3 AND c.e <> 1
"""

ORACLE["echo_complete"] = """
SELECT custom_id, attempt, CASE WHEN bad THEN NULL ELSE 'echo: ' || content END AS content,
       CASE WHEN bad THEN 'refused; refused; refused; refused; refused' END AS error,
       CAST(CASE WHEN bad THEN 5 ELSE 1 END AS BIGINT) AS tries
FROM (SELECT *, attempt = 0 AND ends_with(custom_id, '7') AS bad FROM fx_attempts)
"""

ORACLE["clean_response"] = """
SELECT conv_id, pos, attempt, trim(trim(content, '"'), 'user: ') AS compat_text,
       CASE WHEN starts_with(trim(content, '"'), 'user: ') THEN substring(trim(content, '"'), 7)
            ELSE trim(content, '"') END AS prefix_text
FROM fx_attempts
"""

for _flow in ("starter", "turn"):
    ORACLE[f"{_flow}_triage"] = f"""
SELECT a.lang, CAST(count(*) FILTER (WHERE a.accepted) AS BIGINT) AS n_accepted,
       CAST(count(*) FILTER (WHERE NOT a.accepted) AS BIGINT) AS n_rejected
FROM fx_attempts a JOIN fx_win w USING (custom_id)
WHERE a.flow = '{_flow}' AND (w.a_star IS NULL OR a.attempt <= w.a_star)
GROUP BY a.lang
"""
    ORACLE[f"{_flow}_fold"] = f"""
SELECT custom_id, winning_attempt, final_content FROM fx_fold WHERE flow = '{_flow}'
"""

ORACLE["round_convergence"] = """
SELECT a.flow, a.attempt, CAST(count(*) AS BIGINT) AS n_evaluated,
       CAST(count(*) FILTER (WHERE NOT a.accepted) AS BIGINT) AS n_rejected
FROM fx_attempts a JOIN fx_win w USING (custom_id)
WHERE w.a_star IS NULL OR a.attempt <= w.a_star
GROUP BY a.flow, a.attempt
"""

_PREFIX_CLEAN = ("CASE WHEN starts_with(trim(n.final_content, '\"'), 'user: ') "
                 "THEN substring(trim(n.final_content, '\"'), 7) ELSE trim(n.final_content, '\"') END")

ORACLE["append_turn"] = f"""
WITH lastu AS (
  SELECT d.conv_id, max(m.pos) FILTER (WHERE m.role = 'user') AS p
  FROM fx_dial d LEFT JOIN fx_msgs m USING (conv_id) GROUP BY d.conv_id
),
base AS (
  SELECT l.conv_id, m.pos, m.role, m.content FROM lastu l JOIN fx_msgs m USING (conv_id)
  WHERE l.p IS NULL OR l.p = 0 OR m.pos < l.p
),
newt AS (
  SELECT l.conv_id, contains(n.final_content, {END}) AS ends, {_PREFIX_CLEAN} AS cleaned
  FROM lastu l JOIN fx_fold n ON n.flow = 'turn' AND n.conv_id = l.conv_id AND n.pos = l.p
  WHERE l.p > 0
),
lastb AS (
  SELECT conv_id, count(*) AS nb, arg_max(role, pos) AS lr, arg_max(content, pos) AS lc FROM base GROUP BY conv_id
)
SELECT l.conv_id,
       CAST(coalesce(b.nb, 0) + CASE WHEN n.conv_id IS NOT NULL AND NOT n.ends THEN 1 ELSE 0 END AS BIGINT) AS n_msgs,
       coalesce(n.ends, false) AS ended,
       CASE WHEN n.conv_id IS NOT NULL AND NOT n.ends THEN 'user' ELSE b.lr END AS last_role,
       CASE WHEN n.conv_id IS NOT NULL AND NOT n.ends THEN n.cleaned ELSE b.lc END AS last_content
FROM lastu l LEFT JOIN lastb b USING (conv_id) LEFT JOIN newt n USING (conv_id)
"""

ORACLE["new_dialogues"] = f"""
WITH r AS (
  SELECT lang, text AS scene, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS row_idx FROM documents
)
SELECT row_idx, 'r1-docs-' || lang || '-m1-' || row_idx AS source, lang, scene || {q(P.LANG_LINE)} || lang AS scene,
       CAST(CASE WHEN row_idx % 11 = 5 OR row_idx % 10 = 3 THEN 0 ELSE 1 END AS BIGINT) AS n_msgs,
       CASE WHEN row_idx % 11 <> 5 AND row_idx % 10 <> 3 THEN 'Hello r1-docs-' || lang || '-m1-' || row_idx END AS first_content,
       row_idx % 11 <> 5 AND row_idx % 10 = 3 AS ended_default, false AS ended_compat, row_idx % 11 = 5 AS missing
FROM r
"""

ORACLE["end_rates"] = f"""
WITH fe AS (
  SELECT conv_id, min(pos) AS first_end FROM fx_fold
  WHERE flow = 'turn' AND contains(final_content, {END}) GROUP BY conv_id
),
t AS (SELECT DISTINCT pos AS turn FROM fx_fold WHERE flow = 'turn'),
n AS (SELECT count(*) AS n FROM fx_dial)
SELECT t.turn,
       round(100.0::DOUBLE * (SELECT count(*) FROM fe WHERE fe.first_end <= t.turn) / n.n, 6) AS pct_ended,
       round(100.0::DOUBLE * (SELECT count(*) FROM fe WHERE fe.first_end = t.turn) / n.n, 6) AS pct_new
FROM t, n
"""

ORACLE["orphan_check"] = """
WITH v AS (SELECT custom_id || '/' || attempt AS custom_id FROM fx_attempts WHERE conv_id % 12 <> 0),
c AS (SELECT custom_id || '/' || attempt AS custom_id FROM fx_comp WHERE conv_id % 12 <> 1)
SELECT 'verdict_without_completion' AS side,
       CAST((SELECT count(*) FROM v WHERE custom_id NOT IN (SELECT custom_id FROM c)) AS BIGINT) AS n
UNION ALL
SELECT 'completion_without_verdict',
       CAST((SELECT count(*) FROM c WHERE custom_id NOT IN (SELECT custom_id FROM v)) AS BIGINT)
"""

ORACLE["job_manifest"] = """
SELECT m.job_id, m.input_path, CAST(count(c.custom_id) AS BIGINT) AS n_requests,
       CAST(count(c.custom_id) FILTER (WHERE c.content IS NOT NULL) AS BIGINT) AS n_completed
FROM (SELECT DISTINCT 'job-' || (conv_id % 6) AS job_id, 'requests/lang=' || lang AS input_path FROM fx_dial) m
LEFT JOIN fx_comp c ON 'requests/lang=' || c.lang = m.input_path
GROUP BY m.job_id, m.input_path
"""

ORACLE["param_check"] = """
SELECT model, CAST(count(DISTINCT temperature) AS BIGINT) AS n_param_sets,
       arg_min(temperature, row_idx) AS first_temperature
FROM (SELECT row_idx, 'm' || (conv_id % 2) AS model,
             CASE WHEN conv_id % 8 = 1 THEN 1.5::DOUBLE ELSE 0.9::DOUBLE END AS temperature FROM fx_dial)
GROUP BY model
"""

ORACLE["eval_grid"] = f"""
SELECT l.lang, u.user_model, t.target_model, CAST(coalesce(c.n, 0) AS BIGINT) AS n_dialogues
FROM (SELECT unnest({LANGS_SQL}) AS lang) l
CROSS JOIN (SELECT unnest(['user-a', 'user-b']) AS user_model) u
CROSS JOIN (SELECT unnest(['bot-1', 'bot-2', 'bot-3', 'bot-4', 'bot-5', 'bot-6', 'bot-7', 'bot-8']) AS target_model) t
LEFT JOIN (
  SELECT lang, ['user-a', 'user-b'][(conv_id // 6) % 2 + 1] AS u, 'bot-' || ((conv_id // 12) % 8 + 1) AS t, count(*) AS n
  FROM fx_dial GROUP BY ALL) c ON c.lang = l.lang AND c.u = u.user_model AND c.t = t.target_model
"""

ORACLE["thin_cells"] = """
SELECT row_idx, lang, user_model, target_model FROM (
  SELECT *, sum(n_first) OVER () / CAST(sum(is_first) OVER () AS DOUBLE) AS mean FROM (
    SELECT *, count(*) OVER w AS n,
           CASE WHEN row_number() OVER (w ORDER BY row_idx) = 1 THEN 1 ELSE 0 END AS is_first,
           1 AS n_first
    FROM (
      SELECT row_idx, lang, ['user-a', 'user-b'][(conv_id // 6) % 2 + 1] AS user_model, 'bot-' || ((conv_id // 12) % 8 + 1) AS target_model
      FROM fx_dial)
    WINDOW w AS (PARTITION BY lang, user_model, target_model)))
WHERE n < mean
"""

ORACLE["token_estimates"] = """
SELECT doc_id, CAST(4 + ceil(length('user') / 4) + ceil(length(text) / 4) + 2 + 15 AS BIGINT) AS est_tokens
FROM documents
"""

# The throttled loop, a request at a time: last start, and when each bucket is full again, in units of 60 / (200 * 5000) s.
ORACLE["rate_plan"] = """
WITH RECURSIVE e AS (SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS est FROM documents),
r AS (SELECT doc_id, est, row_number() OVER (ORDER BY doc_id) AS i FROM e WHERE est <= 5000),
t(i, s, fr, ft) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT x.i, x.s, greatest(x.fr, x.s) + 5000, greatest(x.ft, x.s) + x.est * 200
  FROM (SELECT r.i, r.est, t.fr, t.ft, greatest(t.s, t.fr - 199 * 5000, t.ft - (5000 - r.est) * 200) AS s FROM t JOIN r ON r.i = t.i + 1) x
)
SELECT e.doc_id, CAST(row_number() OVER (ORDER BY e.doc_id) - 1 AS BIGINT) AS task_id,
       round(t.s * 60.0::DOUBLE / 1000000.0::DOUBLE, 6) AS start_s, e.est > 5000 AS oversize
FROM e LEFT JOIN r USING (doc_id) LEFT JOIN t USING (i)
"""

ORACLE["attempt_ledger"] = """
SELECT task, tries, status, n_errors, errors, messages FROM fx_ledger
"""

ORACLE["run_counters"] = """
SELECT CAST(count(*) AS BIGINT) AS n_started,
       CAST(count(*) FILTER (WHERE status = 'succeeded') AS BIGINT) AS n_succeeded,
       CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS n_failed,
       CAST(count(*) FILTER (WHERE status = 'in_progress') AS BIGINT) AS n_in_progress,
       CAST(sum(len(list_filter(string_split(errors, ','), lambda x: x = 'rate_limit'))) AS BIGINT) AS n_rate_limit_errors,
       CAST(sum(len(list_filter(string_split(errors, ','), lambda x: x = 'api'))) AS BIGINT) AS n_api_errors,
       CAST(sum(len(list_filter(string_split(errors, ','), lambda x: x = 'other'))) AS BIGINT) AS n_other_errors
FROM fx_ledger
"""

ORACLE["rate_audit"] = """
SELECT strftime(time_bucket(INTERVAL 1 minute, ts), '%Y-%m-%d %H:%M:%S') AS minute, CAST(count(*) AS BIGINT) AS n,
       count(*) > 2 AS over_limit
FROM events GROUP BY 1
"""

ORACLE["rule_concise"] = """
SELECT conv_id, pos,
       CAST(len(list_filter(regexp_split_to_array(content, '[.!?。！？]+'), lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS metric,
       len(list_filter(regexp_split_to_array(content, '[.!?。！？]+'), lambda x: regexp_matches(x, '\\S'))) > 2 AS flag
FROM fx_rules WHERE role = 'user'
"""

ORACLE["rule_placeholder"] = """
SELECT conv_id, pos, CAST(len(regexp_extract_all(content, 'Person ?[XYZ]')) AS BIGINT) AS metric,
       len(regexp_extract_all(content, 'Person ?[XYZ]')) > 0 AS flag
FROM fx_rules
"""

ORACLE["rule_repetition"] = """
SELECT r.conv_id, r.pos, round(coalesce(s.m, 0.0), 6) AS metric, round(coalesce(s.m, 0.0), 6) >= 0.1 AS flag
FROM fx_rules r LEFT JOIN (
  SELECT conv_id, pos, max(jac) AS m FROM fx_pairsim WHERE role_a = role_b GROUP BY conv_id, pos
) s USING (conv_id, pos)
"""

ORACLE["rule_language"] = """
SELECT conv_id, pos, metric, flag FROM fx_lang
"""

ORACLE["rule_role"] = """
SELECT conv_id, pos, metric, metric > 0 AS flag FROM fx_role
"""

ORACLE["clean_dialogues"] = """
SELECT conv_id, NOT bool_or(flag) AS keep FROM (
  SELECT conv_id, metric > 0 AS flag FROM fx_role
  UNION ALL SELECT conv_id, flag FROM fx_lang)
GROUP BY conv_id
"""

ORACLE["judge_parse"] = """
SELECT custom_id, issue, label, is_valid FROM fx_parsed2
"""

ORACLE["issue_rates"] = """
WITH x AS (
  SELECT 'judge-' || (p.doc_id % 2) AS evaluator, d.lang, 'bot-' || (p.doc_id % 3 + 1) AS model, p.issue, p.label
  FROM fx_parsed2 p JOIN documents d USING (doc_id) WHERE p.is_valid
)
SELECT evaluator, lang, model, issue, CAST(count(*) AS BIGINT) AS n, round(avg(label), 6) AS rate FROM x GROUP BY ALL
UNION ALL
SELECT 'ALL', 'ALL', 'ALL', issue, CAST(count(*) AS BIGINT), round(avg(label), 6) FROM x GROUP BY issue
"""

ORACLE["judge_agreement"] = """
WITH j AS (
  SELECT 'judge_a' AS judge, toxic, CASE WHEN doc_id % 10 = 0 THEN 1 - toxic ELSE toxic END AS pred FROM labels
  UNION ALL
  SELECT 'judge_b', toxic, CASE WHEN doc_id % 4 = 1 THEN 1 - toxic ELSE toxic END FROM labels
),
c AS (
  SELECT judge, count(*)::DOUBLE AS n,
         count(*) FILTER (WHERE toxic = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE toxic <> 1 AND pred <> 1) AS tn,
         count(*) FILTER (WHERE toxic <> 1 AND pred = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND pred <> 1) AS fn
  FROM j GROUP BY judge
),
k AS (
  SELECT judge, n, (tp + tn) / n AS po,
         ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM c
)
SELECT judge, CAST(n AS BIGINT) AS n, round(po, 6) AS accuracy,
       round(CASE WHEN pe < 1.0 THEN (po - pe) / (1.0 - pe) END, 6) AS kappa
FROM k
"""

ORACLE["stratified_sample"] = """
SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r
  FROM documents)
WHERE r <= 5
"""


ORACLE["stream_ingest"] = """
SELECT CASE WHEN e = 1 THEN NULL ELSE custom_id END AS custom_id, attempt, content, error FROM fx_comp
"""
ORACLE["stream_rate_audit"] = ORACLE["rate_audit"]
ORACLE["stream_conflicts"] = """
SELECT CASE WHEN e = 1 THEN NULL ELSE custom_id END AS custom_id, attempt,
       CAST(CASE WHEN conv_id % 4 = 1 THEN 2 ELSE 1 END + CASE WHEN e <> 1 AND conv_id % 5 = 2 THEN 1 ELSE 0 END
            + CASE WHEN content IS NOT NULL AND conv_id % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
       content IS NOT NULL AND conv_id % 7 = 3 AS conflict
FROM fx_comp
"""
ORACLE["stream_orphans"] = """
SELECT custom_id, attempt, (conv_id * 3 + pos + attempt) % 11 <> 0 AND (conv_id * 13 + pos * 7 + attempt * 5) % 50 <= 30 AS answered
FROM fx_attempts
"""
ORACLE["journal_complete"] = ORACLE["echo_complete"]
ORACLE["turn_fold_merged"] = ORACLE["turn_fold"]
# The answers of attempt 0 are missing for some conversations: those attempts are rejected without a text.
for _flow, _last in (("turn", K.MAX_TURN_ROUNDS), ("starter", K.MAX_STARTER_ROUNDS)):
    _none = END if _flow == "turn" else "a0.content"
    ORACLE[f"{_flow}_loop"] = f"""
WITH l AS (
  SELECT *, conv_id % 13 = 6 AND attempt = 0 AS lost FROM fx_attempts WHERE flow = '{_flow}'
),
w AS (SELECT custom_id, min(attempt) FILTER (WHERE accepted AND NOT lost) AS a FROM l GROUP BY custom_id)
SELECT w.custom_id, w.a AS winning_attempt,
       CASE WHEN w.a IS NOT NULL THEN x.content ELSE {_none} END AS final_content
FROM w LEFT JOIN l x ON x.custom_id = w.custom_id AND x.attempt = w.a
LEFT JOIN l a0 ON a0.custom_id = w.custom_id AND a0.attempt = 0 AND NOT a0.lost
"""


def oracle_sql() -> dict[str, str]:
    """Complete statements: the fixture CTEs followed by each query body."""
    out = {}
    for key, body in ORACLE.items():
        body = body.strip()
        if body.upper().startswith("WITH RECURSIVE "):
            out[key] = "WITH RECURSIVE " + FIXTURE_CTES.strip() + ",\n" + body[15:]
        elif body.upper().startswith("WITH "):
            out[key] = "WITH " + FIXTURE_CTES.strip() + ",\n" + body[5:]
        else:
            out[key] = "WITH " + FIXTURE_CTES.strip() + "\n" + body
    return out
