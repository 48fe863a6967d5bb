"""The same queries in SQL for DuckDB, over whole tables.

Small helpers below return SQL text for an expression. They are written for SQL on its own
terms: word runs instead of look-around, list filters instead of hash sets, one list fold for
subsequences.
"""

from __future__ import annotations

import re

from verdigris import fixed_values as fixed
from verdigris.plans.fixtures import DATASET_NAMES, TEMPLATES

ORACLES: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(fixed.WHITESPACE)})"


def strip_or_empty(x: str) -> str:
    return strip(f"coalesce({x}, '')")


def filled(template: str, **fields: str) -> str:
    pattern = "|".join(re.escape(f"{{{name}}}") for name in fields)
    parts = [p for p in re.split(f"({pattern})", template) if p]
    return "(" + " || ".join(fields.get(p[1:-1], lit(p)) if p.startswith("{") else lit(p) for p in parts) + ")"


def norm(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    runs = f"regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    kept = f"array_to_string(list_transform({runs}, lambda r: CASE WHEN r IN ('a','an','the') THEN ' ' ELSE r END), '')"
    spaces = (
        "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    )
    return f"trim(regexp_replace({kept}, '{spaces}', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def harmonic(overlap: str, n_gold: str, n_answer: str) -> str:
    """F score of an overlap; written out as precision and recall."""
    p, r = f"(({overlap})::DOUBLE / ({n_answer}))", f"(({overlap})::DOUBLE / ({n_gold}))"
    return (
        f"CASE WHEN ({n_gold}) = 0 OR ({n_answer}) = 0 OR ({overlap}) = 0 THEN 0.0::DOUBLE "
        f"ELSE 2 * {p} * {r} / ({p} + {r}) END"
    )


def f1(g: str, p: str) -> str:
    """F1 of two token list columns, counting each distinct gold token on both sides."""
    overlap = (
        f"coalesce(list_sum(list_transform(list_distinct({g}), lambda t: least("
        f"len(list_filter({g}, lambda a: a = t)), len(list_filter({p}, lambda b: b = t))))), 0)"
    )
    return f"CASE WHEN len({g}) = 0 AND len({p}) = 0 THEN 1.0 ELSE {harmonic(overlap, f'len({g})', f'len({p})')} END"


def rouge_toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def common_length(a: str, b: str) -> str:
    """Longest common subsequence of two list columns: matches by rising left and falling right
    place, folded into the smallest tails of rising sequences."""
    places = f"list_reverse(list_filter(range(1, len({b}) + 1), lambda j: {b}[j] = t))"
    matches = f"list_transform(flatten(list_transform({a}, lambda t: {places})), lambda j: [j])"
    at = "len(list_filter(tails, lambda q: q < x[1]))"
    return (
        f"len(list_reduce(list_prepend([]::BIGINT[], {matches}), "
        f"lambda tails, x: list_concat(list_concat(tails[:{at}], x), tails[{at} + 2:])))"
    )


def final_number(x: str) -> str:
    return f"coalesce(regexp_extract_all(string_split({x}, '####')[-1], '-?\\p{{Nd}}*\\.\\p{{Nd}}+|-?\\p{{Nd}}+')[-1], '')"


def numbers_agree(a: str, b: str) -> str:
    return f"CASE WHEN abs(try_cast({a} AS DOUBLE) - try_cast({b} AS DOUBLE)) <= 0.001 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def list_text(values: str) -> str:
    escaped = r"replace(replace(replace(replace(v, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
    return (
        f"'[' || array_to_string(list_transform({values}, lambda v: CASE "
        f"WHEN contains(v, '''') AND NOT contains(v, '\"') THEN '\"' || {escaped} || '\"' "
        f"ELSE '''' || replace({escaped}, '''', '\\''') || '''' END), ', ') || ']'"
    )


def meta(task: str, text: str | None = None) -> str:
    instruction = lit(fixed.INSTRUCTIONS[task])
    if text is None:
        return filled(fixed.META_PROMPT_INSTRUCTION, instruction=instruction)
    return filled(fixed.META_PROMPT_FULL, instruction=instruction, text=text)


QA = """qa AS (
  SELECT u.conv_id * 100000 + u.turn AS sample_id, u.conv_id, u.turn, u.text AS question, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

ANSWERS = f"""{QA}, answers AS (
  SELECT sample_id, conv_id, question AS answer, string_split(reply, chr(10)) AS target,
    CASE WHEN length(reply) % 7 = 0 THEN NULL ELSE (length(question) % 2)::DOUBLE END AS judged
  FROM qa)"""

REFS = f"""{ANSWERS}, refs AS (
  SELECT sample_id, answer, unnest(target) AS ref, generate_subscripts(target, 1) AS place FROM answers),
ref_tokens AS (
  SELECT *, {norm('ref')} AS nr, {norm('answer')} AS na, {toks('ref')} AS g, {toks('answer')} AS p,
    {rouge_toks('ref')} AS rg, {rouge_toks('answer')} AS rp FROM refs),
ref_scores AS (
  SELECT sample_id, place, CASE WHEN nr = na THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, {f1('g', 'p')} AS f1,
    {harmonic(common_length('rp', 'rg'), 'len(rg)', 'len(rp)')} AS rouge
  FROM ref_tokens),
scored AS (
  SELECT r.sample_id, any_value(a.conv_id) AS conv_id, any_value(a.answer) AS answer, any_value(a.judged) AS judged,
    max(em) AS em, max(f1) AS f1, max(em) FILTER (place = 1) AS em_first, max(f1) FILTER (place = 1) AS f1_first,
    max(rouge) AS rouge
  FROM ref_scores r JOIN answers a USING (sample_id) GROUP BY r.sample_id)"""

DIGEST = """SELECT sample_id, md5(prompt) AS prompt_md5, len(target) AS n_targets,
  md5(array_to_string(target, '|')) AS target_md5, md5(text) AS text_md5, original FROM samples"""

NEWS = f"""raw AS (
  SELECT doc_id AS sample_id, {strip('text')} AS article, {strip("string_split(text, chr(10))[1]")} AS summary FROM documents),
kept AS (SELECT * FROM raw WHERE article <> '' AND summary <> '' AND length(article) <= 5000),
texts AS (SELECT sample_id, [summary] AS target, chr(10) || 'Text: ' || article AS text FROM kept)"""


def samples(task: str, full_prompt: bool) -> str:
    return (
        f"samples AS (SELECT sample_id, target, text, {lit(fixed.INSTRUCTIONS[task])} AS original, "
        f"{meta(task, 'text' if full_prompt else None)} AS prompt FROM texts)"
    )


ORACLES["prep_summaries"] = f"WITH {NEWS}, {samples('cnndm', True)} {DIGEST}"

ORACLES["prep_sci"] = f"""WITH raw AS (
  SELECT doc_id AS sample_id, {strip("array_to_string(string_split(text, chr(10)), ' ')")} AS article,
    {strip("string_split(text, chr(10))[1]")} AS summary FROM documents),
kept AS (SELECT * FROM raw WHERE article <> '' AND summary <> '' AND length(article) <= 5000),
texts AS (SELECT sample_id, [summary] AS target, chr(10) || 'Text: ' || article AS text FROM kept),
{samples('scitldr', True)} {DIGEST}"""

ORACLES["prep_qa_context"] = f"""WITH raw AS (
  SELECT doc_id AS sample_id, {strip("string_split(text, chr(10))[1]")} AS question,
    {strip("string_split(text, chr(10))[-1]")} AS answer,
    replace(array_to_string(string_split(text, chr(10)), ' '), '. ', ' ') AS spaced,
    array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda p: string_split(p, '. '))), ' ') AS context
  FROM documents),
texts AS (SELECT sample_id, [answer] AS target,
    chr(10) || 'Context: ' || context || chr(10) || 'Question: ' || question AS text
  FROM raw WHERE question <> '' AND answer <> '' AND context <> ''),
{samples('hotpot', True)} {DIGEST}"""

ORACLES["prep_nested_answers"] = f"""WITH {QA}, texts AS (
  SELECT sample_id,
    list_filter(list_transform(string_split(reply, chr(10)), lambda t: {strip('t')}), lambda t: t <> '') AS target,
    chr(10) || 'Question: ' || {strip('question')} AS text
  FROM qa WHERE {strip('question')} <> ''),
{samples('nq', False)} {DIGEST}"""

MATH = """problems AS (
  SELECT o_orderkey AS sample_id, [o_totalprice::DECIMAL(18,2)::VARCHAR] AS target,
    chr(10) || 'Question: Order ' || o_orderkey || ' of customer ' || o_custkey AS text FROM orders)"""
ORACLES["prep_math"] = f"WITH {MATH}, texts AS (SELECT * FROM problems), {samples('gsm8k', True)} {DIGEST}"

_modes = " UNION ALL ".join(
    f"SELECT {str(full).lower()} AS full_prompt, sample_id, "
    f"{lit(fixed.CHAT_PREFIX)} || {meta('cnndm', 'text' if full else None)} || {lit(fixed.CHAT_SUFFIX)} AS prompt FROM texts"
    for full in (False, True)
)
ORACLES["prep_end_to_end"] = f"""WITH {NEWS}, modes AS ({_modes}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY full_prompt ORDER BY md5('42:' || sample_id), sample_id) AS rn,
    count(*) OVER (PARTITION BY full_prompt) AS n FROM modes),
parted AS (SELECT *, CASE WHEN rn <= ceil(n::DOUBLE * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY full_prompt, part
    ORDER BY md5(CASE WHEN part = 'train' THEN '43:' ELSE '42:' END || sample_id), sample_id) - 1 AS pos FROM parted)
SELECT full_prompt, part, pos // 64 AS batch_id, count(*) AS n,
  string_agg(sample_id::VARCHAR, ',' ORDER BY pos) AS ids, md5(string_agg(prompt, '|' ORDER BY pos)) AS prompts_md5
FROM placed GROUP BY full_prompt, part, pos // 64"""

ORACLES["prep_evaluation"] = f"""WITH raw AS (
  SELECT 'gsm8k' AS dataset, o_orderkey AS id FROM orders
  UNION ALL SELECT 'cnndm', o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT {fixed.CNNDM_HEAD})
  UNION ALL SELECT 'nq', o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey OFFSET {fixed.NQ_SKIP})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || id), id) AS rn,
    count(*) OVER (PARTITION BY dataset) AS n FROM raw),
parted AS (SELECT *, CASE WHEN rn <= ceil(n::DOUBLE * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY dataset, part
    ORDER BY md5(CASE WHEN part = 'train' THEN '43:' ELSE '42:' END || id), id) - 1 AS pos
  FROM parted WHERE part = 'train' OR rn <= {fixed.EVALUATION_HEAD})
SELECT dataset, part, pos // 64 AS batch_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids
FROM placed GROUP BY dataset, part, pos // 64"""

_kept = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
_sums = ", ".join(f"coalesce(sum({c}), 0)::DOUBLE AS sum_{c}" for c in _kept)
ORACLES["slice_ties"] = f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem),
cuts AS (SELECT unnest([1234, 5001, 23456])::BIGINT AS n, ['first', 'rest'] AS sides),
wanted AS (SELECT n, unnest(sides) AS side FROM cuts)
SELECT w.n, w.side, count(rn) AS rows, {_sums}, coalesce(min(l_orderkey), -1) AS first_key, coalesce(max(l_orderkey), -1) AS last_key
FROM wanted w LEFT JOIN placed p ON (w.side = 'first') = (p.rn <= w.n) GROUP BY w.n, w.side"""

ORACLES["load_parquet"] = f"WITH {NEWS}, {samples('cnndm', True)} {DIGEST} WHERE sample_id < 700"
ORACLES["load_json"] = ORACLES["prep_math"]
ORACLES["load_json_array"] = ORACLES["prep_sci"]

ORACLES["slice_head"] = """SELECT doc_id AS ord, length(text) AS n_chars, md5(text) AS text_md5
FROM documents ORDER BY doc_id LIMIT 500 OFFSET 250"""

ORACLES["slice_skip"] = """SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT * FROM orders ORDER BY o_orderkey OFFSET 250) GROUP BY o_orderpriority"""

ORACLES["split_exact"] = """SELECT doc_id, lang,
  row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= ceil(count(*) OVER ()::DOUBLE * 0.1::DOUBLE) AS is_test
FROM documents"""

ORACLES["split_threshold"] = """SELECT o_orderkey, o_custkey,
  ('0x' || substr(md5('42:' || o_orderkey), 1, 7))::BIGINT < 26843545 AS is_test FROM orders"""

ORACLES["batch_collate"] = """WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT pos // 32 AS batch_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY pos) AS ids,
  sum(n_chars)::BIGINT AS chars FROM p GROUP BY pos // 32"""

ORACLES["sample_projection"] = f"""WITH {NEWS}, {samples('cnndm', False)}
SELECT sample_id, md5({strip('prompt')}) AS prompt_md5, original, md5(original || {strip('text')}) AS query_md5,
  target[1] AS reference_answer FROM samples"""

ORACLES["prompt_pair_union"] = f"""WITH first AS (
  SELECT conv_id * 100000 + turn AS ord, md5({filled(fixed.TUNE_REWRITE, prompt=strip('text'))}) AS query_md5,
    role AS explanation, md5({strip("string_split(text, chr(10))[1]")}) AS rewrite_md5, NULL::VARCHAR AS rating
  FROM conversations),
second AS (
  SELECT doc_id AS ord, md5({filled(fixed.TUNE_RATING, prompt=strip('text'))}) AS query_md5,
    {lit(fixed.RATING_EXPLANATION)} AS explanation, NULL::VARCHAR AS rewrite_md5,
    CASE WHEN lang <> 'es' THEN (n_chars % 5) || '.5' ELSE 'N/A' END AS rating
  FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) FROM conversations))
SELECT * FROM first UNION ALL SELECT * FROM second"""

ORACLES["load_prompt_sets"] = ORACLES["prompt_pair_union"]

_names = "[" + ", ".join(lit(n) for n in DATASET_NAMES) + "]"
_task_rows = ", ".join(f"({lit(a)}, {lit(t)}, {lit(fixed.INSTRUCTIONS[t])})" for a, t in fixed.TASK_ALIASES.items())
ORACLES["task_instruction"] = f"""WITH d AS (
  SELECT doc_id, text, {_names}[regexp_extract(source, '([0-9]+)$', 1)::INT % {len(DATASET_NAMES)} + 1] AS dataset FROM documents),
tasks(alias, task, instruction) AS (VALUES {_task_rows})
SELECT doc_id, dataset, task, instruction,
  md5({lit(fixed.CHAT_PREFIX)} || instruction || ' ' || text || {lit(fixed.CHAT_SUFFIX)}) AS chat_md5
FROM d LEFT JOIN tasks ON lower(d.dataset) = alias"""


def word_ids(words: str) -> str:
    return f"list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT)"


ORACLES["pack_sequences"] = f"""WITH ids AS (
  SELECT doc_id, ({word_ids("string_split(string_split(text, chr(10))[1], ' ')")})[:1024] AS p,
    list_append({word_ids("string_split(text, ' ')")}, 1) AS t FROM documents),
cut AS (SELECT doc_id, p, t[:1024 - len(p)] AS t, 1024 - len(p) - len(t[:1024 - len(p)]) AS pad FROM ids),
packed AS (
  SELECT doc_id, list_concat(list_concat(p, t), list_transform(range(pad), lambda i: 0)) AS input_ids,
    list_concat(list_concat(list_transform(p, lambda i: -100), t), list_transform(range(pad), lambda i: -100)) AS labels,
    list_concat(list_transform(range(1024 - pad), lambda i: 1), list_transform(range(pad), lambda i: 0)) AS attention_mask
  FROM cut)
SELECT doc_id, len(input_ids) AS length, md5(array_to_string(input_ids, ',')) AS input_ids_md5,
  md5(array_to_string(labels, ',')) AS labels_md5, md5(array_to_string(attention_mask, ',')) AS attention_mask_md5
FROM packed"""

ORACLES["encode_vocabulary"] = """WITH words AS (
  SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS pos
  FROM conversations WHERE turn % 5 <> 4 AND turn % 7 <> 6),
vocabulary AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM words))
SELECT c.conv_id, c.turn, count(id) AS n, coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos), '') AS ids
FROM conversations c LEFT JOIN (SELECT * FROM words JOIN vocabulary USING (token)) w ON w.conv_id = c.conv_id AND w.turn = c.turn
GROUP BY c.conv_id, c.turn"""

_fields = {"query": "question", "final_answer": "reply", "target_answers": "reference_text"}
_quality = filled(TEMPLATES["prompt_quality"], query="question", rewritten_query="reply")
_answer = (
    f"CASE WHEN turn = 0 THEN {filled(TEMPLATES["summary"], **_fields)} ELSE {filled(TEMPLATES["answer"], **_fields)} END"
)
ORACLES["render_judge"] = f"""WITH {QA}, q AS (
  SELECT *, {list_text("string_split(reply, chr(10))")} AS reference_text FROM qa)
SELECT sample_id, md5({_quality}) AS quality_md5, md5({_quality} || '{{') AS quality_open_md5,
  md5({_answer}) AS answer_md5, md5(({_answer}) || '{{') AS answer_open_md5,
  md5({filled(TEMPLATES["test_answer"], **_fields)}) AS test_md5, sha256(question || 't=0') AS request_id FROM q"""

ORACLES["candidate_fan_out"] = f"""WITH {QA} SELECT sample_id, unnest(range(4))::INT AS cand_idx,
  md5({filled(TEMPLATES["candidate"], original_query='question', reference_answer='reply')}) AS request_md5 FROM qa"""

_intro = f"{lit(fixed.SELECT_INTRO)} || {lit(fixed.INSTRUCTIONS['nq'])}"
_option = "'. Version ' || k || ' of ' || reply"
ORACLES["render_selection"] = f"""WITH {QA}, c AS (SELECT sample_id, question, reply, unnest(range(5)) AS k FROM qa)
SELECT sample_id,
  md5({_intro} || ' ' || any_value(question) || {lit(fixed.SELECT_LIST)}
    || string_agg((k + 1) || {_option}, '' ORDER BY k) || {lit(fixed.SELECT_NUMBER_TAIL)}) AS example_md5,
  md5({_intro} || {lit(fixed.SELECT_LIST)}
    || string_agg((k + 1) || {_option} || chr(10), '' ORDER BY k) || {lit(fixed.SELECT_JSON_TAIL)}) AS instruction_md5
FROM c GROUP BY sample_id"""

# What the six shapes hold is known from how they are made.
EVENTS = """e AS (
  SELECT event_id AS sample_id, event_id % 6 AS shape, user_id, event_type, value,
    json_extract_string(props, '$.k')::INT AS k, 'Do ' || event_type || ' ' || json_extract_string(props, '$.k') AS rewrite
  FROM events),
c AS (SELECT *,
    '"explanation": "' || event_type || '", "final_rewritten_query": "' || rewrite || '"}' AS body,
    '{''explanation'': ''' || event_type || ''', ''final_rewritten_query'': ''' || rewrite || '''}' AS single FROM e),
completions AS (SELECT *, CASE shape WHEN 0 THEN '{' || body
    WHEN 1 THEN '```json' || chr(10) || '{' || body || chr(10) || '```'
    WHEN 2 THEN single WHEN 3 THEN '{' || body || ' and more }' WHEN 4 THEN body ELSE rewrite END AS completion FROM c)"""

_body = "chr(10) || 'Question: ' || event_type"
_follow = f"{lit(fixed.FOLLOW_QUERY)} || {_body} || chr(10) || {lit(fixed.FOLLOW_REWRITE)} || said"
_nq = lit(fixed.INSTRUCTIONS["nq"])
ORACLES["final_prompt"] = f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN shape < 5 THEN rewrite
    WHEN sample_id % 12 = 5 THEN '{{"explanation": "no rewrite"}}' ELSE 'raw ' || rewrite END AS said FROM completions)
SELECT sample_id, md5({_nq} || ' ' || {_body}) AS instruction_md5,
  md5(CASE WHEN sample_id % 12 = 5 THEN said ELSE {_follow} END) AS follow_md5, md5(said || {_body}) AS rewrite_md5,
  md5({lit(fixed.FOLLOW_QUERY)} || {_nq} || ' ' || {_body} || {lit(fixed.FOLLOW_REWRITE)} || said) AS candidate_md5
FROM s"""

ORACLES["run_rewrite"] = "SELECT doc_id, md5('Rewrite for ' || lang || ' ' || text) AS prompt_md5 FROM documents"

_echo = "question || chr(10) || ' ' || reply || ' ' || question"
ORACLES["strip_echo"] = f"""WITH {QA} SELECT sample_id,
  md5({strip(f"substr({_echo}, length(question) + 1)")}) AS stripped_md5,
  md5({strip("CASE WHEN starts_with(reply, question) THEN substr(reply, length(question) + 1) ELSE reply END")}) AS untouched_md5,
  md5({strip(f"replace({_echo}, question, '')")}) AS removed_md5 FROM qa"""

ORACLES["parse_completion"] = f"""WITH {EVENTS} SELECT sample_id,
  CASE WHEN shape < 5 THEN rewrite END AS rewrite,
  CASE shape WHEN 0 THEN 'strict' WHEN 1 THEN 'strict' WHEN 2 THEN 'lenient' WHEN 3 THEN 'cut' WHEN 4 THEN 'cut' ELSE 'failed' END AS outcome,
  CASE WHEN shape < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS json_success, rewrite AS rewrite_or_raw,
  CASE WHEN shape = 4 THEN rewrite END AS prefixed FROM completions"""

ORACLES["parse_score"] = """WITH e AS (SELECT event_id AS sample_id, event_id % 6 AS shape,
    (json_extract_string(props, '$.k')::INT % 6)::DOUBLE AS score FROM events)
SELECT sample_id, CASE WHEN shape = 0 THEN score ELSE -1.0 END AS strict_score,
  CASE WHEN shape = 0 THEN score ELSE 0.0 END AS strict_or_zero,
  CASE WHEN shape < 5 THEN score ELSE -1.0 END AS tolerant_score FROM e"""

ORACLES["parse_choice"] = """SELECT event_id AS sample_id, CASE WHEN event_id % 6 < 5
  THEN json_extract_string(props, '$.k')::BIGINT % 8 - 1 ELSE json_extract_string(props, '$.k')::BIGINT - 1 END AS pick
FROM events"""

ORACLES["qa_em_f1"] = f"""WITH {REFS}
SELECT round(avg(em), 6) AS avg_em, round(avg(f1), 6) AS avg_f1, count(*) AS n FROM scored"""

ORACLES["pair_em_f1"] = f"""WITH t AS (
  SELECT doc_id, {toks("string_split(text, chr(10))[1]")} AS g, {norm('text')} AS nt,
    {norm("string_split(text, chr(10))[1]")} AS ng FROM documents),
gold AS (SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest(g) AS token FROM t) GROUP BY ALL),
pred AS (SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest(string_split(nt, ' ')) AS token FROM t)
  WHERE token <> '' GROUP BY ALL),
sums AS (SELECT t.doc_id, any_value(ng) AS ng, any_value(nt) AS nt,
    coalesce(any_value(a.n), 0) AS n_gold, coalesce(any_value(b.n), 0) AS n_pred, coalesce(any_value(o.n), 0) AS overlap
  FROM t LEFT JOIN (SELECT doc_id, sum(c) AS n FROM gold GROUP BY doc_id) a USING (doc_id)
  LEFT JOIN (SELECT doc_id, sum(c) AS n FROM pred GROUP BY doc_id) b USING (doc_id)
  LEFT JOIN (SELECT doc_id, sum(least(gold.c, pred.c)) AS n FROM gold JOIN pred USING (doc_id, token) GROUP BY doc_id) o
    USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, CASE WHEN ng = nt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em,
  round(CASE WHEN n_gold = 0 AND n_pred = 0 THEN 1.0 ELSE {harmonic('overlap', 'n_gold', 'n_pred')} END, 6) AS f1,
  md5(nt) AS normalized_md5 FROM sums"""

ORACLES["rouge_l"] = f"""WITH {QA}, t AS (SELECT sample_id, {rouge_toks('question')} AS p, {rouge_toks('reply')} AS g FROM qa)
SELECT sample_id, round({harmonic(common_length('p', 'g'), 'len(g)', 'len(p)')}, 6) AS rouge FROM t"""

_answer_text = """CASE o_orderkey % 5 WHEN 0 THEN '3 items. The total is ' || gold || ' EUR'
    WHEN 1 THEN '1 2 #### -' || gold WHEN 2 THEN '#### ' || replace(gold, '.', '')
    WHEN 3 THEN 'total #### ' || format('{:,.2f}', gold::DOUBLE) ELSE 'cannot tell' END"""
ORACLES["numeric_match"] = f"""WITH o AS (
  SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::VARCHAR AS gold FROM orders),
a AS (SELECT *, {_answer_text} AS answer FROM o),
n AS (SELECT *, {final_number('answer')} AS number, {final_number("replace(answer, ',', '')")} AS plain FROM a)
SELECT o_orderkey, number, {numbers_agree("regexp_replace(number, '[-.]', '', 'g')", "regexp_replace(gold, '[-.]', '', 'g')")} AS as_reference,
  {numbers_agree('plain', 'gold')} AS strict FROM n"""

ORACLES["metric_dispatch"] = f"""WITH {REFS}, a AS (
  SELECT *, {final_number('answer')} AS number FROM scored)
SELECT 'rouge' AS metric, round(avg(rouge), 6) AS mean, count(rouge) AS n FROM a
UNION ALL SELECT 'em', round(avg(em_first), 6), count(em_first) FROM a
UNION ALL SELECT 'gsm8k', round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6), count(*) FROM orders
UNION ALL SELECT 'llm_prompt', round(avg(coalesce(judged, -1.0)), 6), count(*) FROM a
UNION ALL SELECT 'llm', round(avg(coalesce(judged, 0.0)), 6), count(*) FROM a
UNION ALL SELECT 'llm_test', round(avg(coalesce(judged, -1.0)), 6), count(*) FROM a
UNION ALL SELECT 'other', NULL, 0 FROM (SELECT 1)"""

SCORES = """s AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_linestatus = 'O' THEN 'cnn_dailymail' WHEN l_returnflag = 'A' THEN 'cnndm' ELSE 'nq' END AS task,
    CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS js,
    CASE WHEN l_linenumber = 7 THEN -1.0::DOUBLE ELSE floor(l_quantity / 10) END AS p1,
    CASE WHEN l_linenumber >= 6 THEN -1.0::DOUBLE ELSE round(l_tax * 50) END AS p2,
    CASE WHEN l_linenumber = 2 THEN -1.0::DOUBLE ELSE round(l_discount * 50) END AS judge,
    CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m
  FROM lineitem)"""
KEYS = "l_orderkey, l_linenumber, l_partkey"

ORACLES["clamp_weight"] = f"""WITH {SCORES} SELECT {KEYS},
  round(CASE WHEN p1 = -1 THEN 0.0 ELSE greatest(least(p1 / 5, 1.0), 0.0) END, 6) AS value,
  CASE WHEN p1 = -1 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM s"""


def weighted(quality: str, scale: str) -> str:
    """Weighted mean over json 0.2, prompt quality 0.3, judge 0.5, without failed parts."""
    q = f"greatest(least(({quality}) / 5, 1.0), 0.0)"
    j = f"greatest(least(judge / ({scale}), 1.0), 0.0)"
    top = f"0.2::DOUBLE * js + CASE WHEN ({quality}) = -1 THEN 0 ELSE 0.3::DOUBLE * {q} END + CASE WHEN judge = -1 THEN 0 ELSE 0.5::DOUBLE * {j} END"
    bottom = f"0.2::DOUBLE + CASE WHEN ({quality}) = -1 THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN judge = -1 THEN 0 ELSE 0.5::DOUBLE END"
    return f"round(({top}) / ({bottom}), 6)"


_strict_quality = "CASE WHEN p1 >= 0 AND p2 >= 0 THEN (p1 + p2) / 2 WHEN p1 >= 0 THEN p1 WHEN p2 >= 0 THEN p2 ELSE -1.0 END"
ORACLES["composite"] = f"""WITH {SCORES} SELECT {KEYS},
  {weighted('(p1 + p2) / 2', "CASE WHEN task = 'cnndm' THEN 5.0 ELSE 1.0 END")} AS as_reference,
  {weighted(_strict_quality, "CASE WHEN task IN ('cnndm', 'cnn_dailymail') THEN 5.0 ELSE 1.0 END")} AS strict FROM s"""

ORACLES["composite_recorded"] = f"""WITH {SCORES}, j AS (SELECT l_orderkey, max(judge) AS judge FROM s GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS js, judge
  FROM orders LEFT JOIN j ON l_orderkey = o_orderkey)
SELECT sample_id, round(CASE WHEN judge IS NULL OR judge = -1 THEN js
  ELSE (0.2::DOUBLE * js + 0.5::DOUBLE * least(judge / 5, 1.0)) / (0.2::DOUBLE + 0.5::DOUBLE) END, 6) AS reward FROM o"""

ORACLES["composite_math"] = f"""WITH {SCORES} SELECT {KEYS},
  round(CASE WHEN p1 <> -1 AND p2 <> 1 THEN m / 2 + p1 / 20 + p2 / 20 WHEN p1 <> -1 THEN m / 2 + p1 / 10
    WHEN p2 <> -1 THEN m / 2 + p2 / 10 ELSE m END, 6) AS as_reference,
  round(CASE WHEN p1 <> -1 AND p2 <> -1 THEN m / 2 + p1 / 20 + p2 / 20 WHEN p1 <> -1 THEN m / 2 + p1 / 10
    WHEN p2 <> -1 THEN m / 2 + p2 / 10 ELSE m END, 6) AS strict, m AS match_only FROM s"""

ORACLES["two_score"] = f"""WITH {SCORES} SELECT {KEYS}, round(CASE WHEN p1 >= 0 AND judge >= 0 THEN p1 / 10 + judge / 5 / 2
  WHEN p1 >= 0 THEN p1 / 5 WHEN judge >= 0 THEN judge / 5 ELSE 0.0 END, 6) AS reward FROM s"""


def z(value: str, part: str) -> str:
    over = f"OVER (PARTITION BY {part})"
    return f"round(({value} - avg({value}) {over}) / (stddev_pop({value}) {over} + 1e-6), 6)"


ORACLES["zscore"] = f"SELECT event_id, {z('value', 'user_id')} AS reward FROM events"

# Only the plain shape has a strict score, and only shapes that start with a brace a prefix parse.
ORACLES["batch_reward_judge"] = f"""WITH e AS (SELECT event_id AS sample_id, user_id,
    CASE WHEN event_id % 6 = 0 THEN (json_extract_string(props, '$.k')::INT % 6)::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM events)
SELECT sample_id, raw AS raw_reward, {z('raw', 'user_id')} AS reward FROM e"""

ORACLES["batch_reward_rouge"] = f"""WITH {REFS}, r AS (
  SELECT sample_id, conv_id, CASE WHEN length(answer) % 4 = 0 THEN 0.0 ELSE rouge END AS raw FROM scored)
SELECT sample_id, round(raw, 6) AS raw_reward, {z('raw', 'conv_id')} AS reward FROM r"""

ORACLES["perplexity"] = """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT vec_id, max(x) AS top FROM v GROUP BY vec_id),
l AS (SELECT vec_id, any_value(label) AS label, -ln(sum(exp(x - top))) AS lp FROM v JOIN m USING (vec_id) GROUP BY vec_id)
SELECT label, round(1 / exp(-avg(lp)), 6) AS reward, count(*) AS n_positions FROM l GROUP BY label"""

ORACLES["user_reward"] = f"""WITH {QA} SELECT sample_id, round(length(question)::DOUBLE / length(reply), 6) AS reward FROM qa"""

_em_f1_first = "round(avg(em_first), 6) AS avg_em, round(avg(f1_first), 6) AS avg_f1"
ORACLES["baseline_report"] = f"""WITH {REFS} SELECT {_em_f1_first}, round(avg(rouge), 6) AS avg_rouge,
  round(avg(judged), 6) AS avg_judge, count(*) AS n FROM scored WHERE judged IS NOT NULL AND answer <> ''"""

_report = "round(avg(rouge), 6) AS avg_rouge, round(avg(coalesce(judged, 0.0)), 6) AS avg_judge, count(*) AS n"
ORACLES["eval_report"] = f"""WITH {REFS} SELECT {_em_f1_first}, {_report}, 'reference' AS mode FROM scored WHERE answer <> ''
UNION ALL SELECT round(avg(em), 6), round(avg(f1), 6), {_report}, 'strict' FROM scored WHERE answer <> ''"""

ORACLES["math_report"] = f"""WITH {MATH}, a AS (
  SELECT target[1] AS gold, CASE WHEN sample_id % 3 = 0 THEN 'I get ' || target[1] ELSE '#### 7' END AS answer FROM problems),
t AS (SELECT {toks('gold')} AS g, {toks('answer')} AS p, {norm('gold')} AS ng, {norm('answer')} AS na,
    {numbers_agree(norm(final_number('answer')), norm('gold'))} AS m FROM a)
SELECT round(avg(CASE WHEN ng = na THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS avg_em, round(avg({f1('g', 'p')}), 6) AS avg_f1,
  round(avg(m), 6) AS avg_rouge, round(avg(m), 6) AS avg_judge, count(*) AS n FROM t"""

ORACLES["rewriter_report"] = f"""WITH {REFS} SELECT {_em_f1_first}, {_report},
  (SELECT count(*) FROM events) AS total_prompts, (SELECT count(*) FROM events WHERE event_id % 6 < 5) AS correct_json_count,
  (SELECT count(*) FROM events WHERE event_id % 6 IN (0, 1)) AS n_strict, (SELECT count(*) FROM events WHERE event_id % 6 IN (3, 4)) AS n_cut,
  (SELECT count(*) FROM events WHERE event_id % 6 = 2) AS n_lenient, 0::BIGINT AS n_pattern,
  (SELECT count(*) FROM events WHERE event_id % 6 = 5) AS n_failed FROM scored WHERE answer <> ''"""

_RUN_TOKENS = f"""refs AS (
  SELECT sample_id, cand_idx, answer, judged, unnest(target) AS ref, generate_subscripts(target, 1) AS place FROM said),
ref_tokens AS (
  SELECT *, {norm('ref')} AS nr, {norm('answer')} AS na, {toks('ref')} AS g, {toks('answer')} AS p,
    {rouge_toks('ref')} AS rg, {rouge_toks('answer')} AS rp FROM refs),
ref_scores AS (
  SELECT sample_id, cand_idx, judged, place, CASE WHEN nr = na THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, {f1('g', 'p')} AS f1,
    {harmonic(common_length('rp', 'rg'), 'len(rg)', 'len(rp)')} AS rouge FROM ref_tokens),
scored AS (
  SELECT sample_id, cand_idx, any_value(judged) AS judge, max(em) FILTER (place = 1) AS em, max(f1) FILTER (place = 1) AS f1,
    max(rouge) AS rouge FROM ref_scores GROUP BY sample_id, cand_idx)"""
_RUN_SAMPLES = f"""{QA}, texts AS (
  SELECT sample_id, list_filter(list_transform(string_split(reply, chr(10)), lambda t: {strip('t')}), lambda t: t <> '') AS target,
    chr(10) || 'Question: ' || {strip('question')} AS text FROM qa WHERE {strip('question')} <> '')"""
_run_follow = f"{lit(fixed.FOLLOW_QUERY)} || text || chr(10) || {lit(fixed.FOLLOW_REWRITE)}"
ORACLES["evaluate_rewriter"] = f"""WITH {_RUN_SAMPLES}, asked AS (
  SELECT *, length(text) % 3 AS shape, CASE length(text) % 3 WHEN 0 THEN {_run_follow} || 'Q' || length(text)
    WHEN 1 THEN '{{"explanation": "none"}}' ELSE {_run_follow} || 'no json' END AS final FROM texts),
recorded AS (SELECT final, min(text) FILTER (length(final) % 7 <> 0) AS answer FROM asked GROUP BY final),
said AS (SELECT sample_id, 0 AS cand_idx, r.answer, target,
    (length(text) % 2)::DOUBLE AS own_judged,
    CASE WHEN r.answer = text THEN (length(text) % 2)::DOUBLE ELSE 0.0::DOUBLE END AS judged
  FROM asked JOIN recorded r USING (final) WHERE coalesce(r.answer, '') <> ''),
{_RUN_TOKENS}
SELECT round(avg(em), 6) AS avg_em, round(avg(f1), 6) AS avg_f1, round(avg(rouge), 6) AS avg_rouge, round(avg(judge), 6) AS avg_judge,
  count(*) AS n, (SELECT count(*) FROM asked) AS total_prompts, (SELECT count(*) FROM asked WHERE shape = 0) AS correct_json_count,
  (SELECT count(*) FROM asked WHERE shape <= 1) AS n_strict, 0::BIGINT AS n_cut, 0::BIGINT AS n_lenient, 0::BIGINT AS n_pattern,
  (SELECT count(*) FROM asked WHERE shape = 2) AS n_failed, count(*) AS logged, round(sum(judge), 6) AS logged_judge,
  'run' AS name, round(avg(rouge), 4) AS written_rouge FROM scored"""

ORACLES["evaluate_sampling"] = f"""WITH {_RUN_SAMPLES}, said AS (
  SELECT sample_id, k AS cand_idx, text || ' ' || k AS answer, target, (k % 2)::DOUBLE AS judged FROM texts, range(5) r(k)),
{_RUN_TOKENS},
per AS (SELECT sample_id, {", ".join(f"max({m}) AS max_{m}, avg({m}) AS mean_{m}" for m in ("em", "f1", "rouge", "judge"))} FROM scored GROUP BY sample_id),
report AS (
  {" UNION ALL ".join("SELECT '" + kind + "' AS kind, " + ", ".join(f"avg({kind}_{m}) AS avg_{m}" for m in ("em", "f1", "rouge", "judge")) + ", count(*) AS n FROM per" for kind in ("max", "mean"))}
  UNION ALL SELECT 'choice', avg(em), avg(f1), avg(rouge), avg(judge), count(*) FROM scored WHERE cand_idx = sample_id % 7 - 1)
SELECT kind, round(avg_em, 6) AS avg_em, round(avg_f1, 6) AS avg_f1, round(avg_rouge, 6) AS avg_rouge, round(avg_judge, 6) AS avg_judge,
  n, round(avg_rouge, 4) AS written_rouge FROM report"""

CANDIDATES = """cand AS (
  SELECT l_orderkey AS sample_id, l_linenumber - 1 AS cand_idx,
    max(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS em, max(l_discount) * 10 AS f1,
    min(l_tax) * 10 AS rouge, CASE WHEN max(l_quantity) >= 49 THEN -1.0::DOUBLE ELSE max(l_quantity) / 50 END AS judge
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
kept AS (SELECT * FROM cand WHERE rouge >= 0 AND judge >= 0)"""
_means = ", ".join(f"round(avg({m}), 6) AS avg_{m}" for m in ("em", "f1", "rouge", "judge"))

ORACLES["candidate_report"] = f"WITH {CANDIDATES} SELECT cand_idx, {_means}, count(*) AS n FROM kept GROUP BY cand_idx"

ORACLES["pick_report"] = f"""WITH {CANDIDATES}, last AS (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
pick AS (SELECT user_id AS run_id, CASE WHEN event_id % 6 < 5 THEN json_extract_string(props, '$.k')::BIGINT % 8 - 1
  ELSE json_extract_string(props, '$.k')::BIGINT - 1 END AS p FROM last)
SELECT run_id, cand_idx, {_means}, count(*) AS n FROM kept JOIN pick ON cand_idx = p GROUP BY run_id, cand_idx"""

_spread = ", ".join(f"max({m}) AS max_{m}, avg({m}) AS mean_{m}" for m in ("em", "f1", "rouge", "judge"))


def _kind(kind: str) -> str:
    means = ", ".join(f"round(avg({kind}_{m}), 6) AS avg_{m}" for m in ("em", "f1", "rouge", "judge"))
    return f"SELECT '{kind}' AS kind, {means}, count(*) AS n FROM per"


ORACLES["best_mean_choice"] = f"""WITH {CANDIDATES}, per AS (SELECT sample_id, {_spread} FROM kept GROUP BY sample_id)
{_kind('max')} UNION ALL {_kind('mean')}
UNION ALL SELECT 'choice', {_means}, count(*) FROM kept JOIN orders ON o_orderkey = sample_id AND o_custkey % 9 - 1 = cand_idx"""

_pair_request = filled(
    TEMPLATES["pairwise"],
    original="text",
    reference="''",
    option_1="CASE WHEN swap THEN option_2 ELSE option_1 END",
    option_2="CASE WHEN swap THEN option_1 ELSE option_2 END",
).replace("CASE", "(CASE").replace("END", "END)")
PAIRS = """joined AS (
  SELECT a.text, a.lang || '-' || a.source AS option_1, b.source || '/' || b.lang AS option_2
  FROM documents a JOIN documents b ON a.text = b.text),
counted AS (SELECT text, option_1, option_2, count(*) AS n_pairs FROM joined GROUP BY ALL),
pairs AS (SELECT *, substr(md5('42:' || text || chr(31) || option_1 || chr(31) || option_2), 1, 1)
    IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swap FROM counted)"""
ORACLES["pairwise_swap"] = f"""WITH {PAIRS} SELECT md5(text) AS original_md5, option_1, option_2, n_pairs, swap,
  md5({_pair_request}) AS request_md5 FROM pairs"""

ORACLES["win_rate"] = f"""WITH {PAIRS}, s AS (
  SELECT n_pairs, CASE WHEN length(text) % 5 <= 2 THEN 1 ELSE 2 END AS raw, swap FROM pairs WHERE length(text) % 5 <> 0)
SELECT round(sum(CASE WHEN (raw = 2) <> swap THEN n_pairs ELSE 0 END)::DOUBLE / sum(n_pairs), 6) AS win_rate,
  sum(n_pairs)::BIGINT AS n FROM s"""


def _cell(answerer: str, judge: str) -> str:
    flag = "l_returnflag = 'A'" if answerer == "first" else "l_returnflag <> 'A'"
    status = "l_linestatus = 'O'" if judge == "first" else "l_linestatus <> 'O'"
    return f"coalesce(max(floor(l_quantity / 10)) FILTER ({flag} AND {status}), -1.0)::DOUBLE AS {answerer}_by_{judge}"


MATRIX = f"""matrix AS (SELECT l_partkey AS ord, l_linenumber - 1 AS cand_idx,
  {', '.join(_cell(a, j) for a in ('first', 'second') for j in ('first', 'second'))} FROM lineitem GROUP BY l_partkey, l_linenumber)"""
ORACLES["judge_matrix"] = f"WITH {MATRIX} SELECT * FROM matrix"

_all_scores = "first_by_first, second_by_first, second_by_second, first_by_second"
ORACLES["quality_gate"] = f"""WITH {MATRIX}
SELECT ord, cand_idx, concat_ws(',', {', '.join(f'{c}::INT' for c in _all_scores.split(', '))}) AS scores,
  least({_all_scores}) >= 3 AS perfect
FROM matrix WHERE least({_all_scores}) >= 2 ORDER BY ord, cand_idx LIMIT 100"""

ORACLES["curated_prompts"] = f"""WITH {MATRIX}, kept AS (
  SELECT ord, cand_idx, concat_ws(',', {', '.join(f'{c}::INT' for c in _all_scores.split(', '))}) AS scores,
    least({_all_scores}) >= 3 AS perfect
  FROM matrix WHERE least({_all_scores}) >= 2 ORDER BY ord, cand_idx LIMIT 100),
texts AS (SELECT kept.*, 'Describe part ' || ord AS original_query,
    p_name || ' ' || p_type || ' of ' || p_brand AS reference_answer, 'Candidate ' || cand_idx AS candidate_prompt,
    p_brand || ' ' || p_name AS final_answer_first, p_type AS final_answer_second
  FROM kept JOIN part ON p_partkey = ord),
t AS (SELECT *, {rouge_toks('final_answer_first')} AS p, {rouge_toks('reference_answer')} AS g FROM texts)
SELECT * EXCLUDE (p, g), round({harmonic(common_length('p', 'g'), 'len(g)', 'len(p)')}, 6) AS rouge_score FROM t"""

ORACLES["rolling_mean"] = """SELECT user_id AS run_id, event_id AS step, round(avg(value) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS running_mean FROM events"""

MOVING = """points AS (
  SELECT user_id AS run_id, event_id AS step, row_number() OVER w - 1 AS pos,
    avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
ORACLES["early_stop_ma"] = f"""WITH {MOVING}, gains AS (
  SELECT *, ma - lag(ma, 20) OVER (PARTITION BY run_id ORDER BY pos) AS gain FROM points)
SELECT run_id, min(step) FILTER (pos >= 29 AND gain < 0.01) AS stop_step, count(*) AS n_points FROM gains GROUP BY run_id"""
ORACLES["stream_early_stop"] = ORACLES["early_stop_ma"]
ORACLES["stream_early_stop_named"] = ORACLES["early_stop_ma"].replace("user_id", "event_type")

# One fold per run over its means: best so far, place of the last improvement, first stop.
ORACLES["early_stop_best"] = f"""WITH {MOVING}, lists AS (
  SELECT run_id, count(*) AS n_points, list([pos::DOUBLE, ma, step::DOUBLE, -1.0] ORDER BY pos) FILTER (pos >= 9) AS means
  FROM points GROUP BY run_id),
folded AS (
  SELECT run_id, n_points, list_reduce(list_prepend([-1.0, -1e300, 0.0, -1.0], means), lambda acc, x: CASE
    WHEN x[2] > acc[2] + 0.01 THEN [x[1], x[2], 0.0, acc[4]]
    WHEN acc[4] < 0 AND x[1] >= 30 AND x[1] - acc[1] >= 15 THEN [acc[1], acc[2], 0.0, x[3]]
    ELSE acc END) AS state FROM lists)
SELECT run_id, CASE WHEN state[4] >= 0 THEN state[4]::BIGINT END AS stop_step, n_points FROM folded"""

_TYPED = """points AS (
  SELECT event_type AS run_id, event_id AS step, row_number() OVER w - 1 AS pos,
    avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS ma
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))"""


def _best_rule(name: str, place: str) -> str:
    return f"""SELECT '{name}' AS rule, run_id, CASE WHEN state[4] >= 0 THEN state[4]::BIGINT END AS stop_step, n_points FROM (
  SELECT run_id, n_points, list_reduce(list_prepend([-1.0, -1e300, 0.0, -1.0], means), lambda acc, x: CASE
    WHEN x[2] > acc[2] + 0.01 THEN [x[1], x[2], 0.0, acc[4]]
    WHEN acc[4] < 0 AND {place} >= 200 AND x[1] - acc[1] >= 100 THEN [acc[1], acc[2], 0.0, x[3]]
    ELSE acc END) AS state FROM lists)"""


ORACLES["early_stop_default"] = f"""WITH {_TYPED}, lists AS (
  SELECT run_id, count(*) AS n_points, list([pos::DOUBLE, ma, step::DOUBLE, -1.0] ORDER BY pos) FILTER (pos >= 24) AS means
  FROM points GROUP BY run_id),
gains AS (SELECT *, ma - lag(ma, 100) OVER (PARTITION BY run_id ORDER BY pos) AS gain FROM points)
SELECT 'moving' AS rule, run_id, min(step) FILTER (pos >= 124 AND gain < 0.01) AS stop_step, count(*) AS n_points FROM gains GROUP BY run_id
UNION ALL {_best_rule('best', 'x[1]')}
UNION ALL {_best_rule('best per epoch', '(x[1]::BIGINT % 500)')}"""

ORACLES["stream_totals"] = """SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type"""

ORACLES["results_log"] = f"""WITH {CANDIDATES} SELECT 'run "x", candidate ' || cand_idx AS "Name", round(avg(em), 4) AS "Accuracy",
  round(avg(f1), 4) AS "F1", round(avg(rouge), 4) AS "ROUGE", round(avg(judge), 4) AS "LLM-as-a-judge" FROM kept GROUP BY cand_idx"""

ORACLES["sample_log"] = f"""WITH {QA} SELECT 'turn' || turn AS run_name, md5(question) AS original_md5,
  md5(' "' || question || '", again ') AS rewrite_md5, md5(reply) AS answer_md5,
  round_even(length(question)::DECIMAL(18,6) / 1000, 2)::DOUBLE AS "Accuracy", -1.0::DOUBLE AS judge FROM qa"""

ORACLES["sample_log_lines"] = ORACLES["sample_log"]

ORACLES["reward_log_scan"] = """SELECT event_id::INT AS step, value AS reward, round(epoch_us(ts) / 1000000.0::DOUBLE, 3) AS ts FROM events"""

ORACLES["json_roundtrip"] = f"""WITH raw AS (
  SELECT doc_id AS sample_id, {strip("array_to_string(string_split(text, chr(10)), ' ')")} AS article,
    {strip("string_split(text, chr(10))[1]")} AS summary FROM documents)
SELECT sample_id, md5({lit(fixed.INSTRUCTIONS['scitldr'])} || 'Text: ' || article) AS query_md5, md5(summary) AS reference_md5
FROM raw WHERE article <> '' AND summary <> '' AND length(article) <= 5000"""

_hook = """CASE WHEN md5(text) LIKE '7%' THEN '' ELSE md5(text) END AS text,
  CASE WHEN md5(text) LIKE '7%' THEN 'refused' END AS error FROM documents"""
ORACLES["batch_hook"] = f"SELECT doc_id, {_hook}"
ORACLES["distinct_requests"] = f"SELECT doc_id, sha256(text || 't=0') AS request_id, {_hook}"
ORACLES["resumed_requests"] = f"""SELECT doc_id, sha256(text || 't=0') AS request_id,
  CASE WHEN md5(text) LIKE '7%' AND bool_or(lang = 'en') OVER (PARTITION BY text) THEN 2 ELSE 1 END AS n_asked, {_hook}"""
ORACLES["recorded_answers"] = """WITH items AS (SELECT text, min(item_id) AS item FROM benchmark GROUP BY text)
SELECT doc_id, coalesce('item ' || item, '') AS text FROM documents LEFT JOIN items USING (text)"""


# Porter stemming over the distinct words, one common table per step. Finished words end in '!',
# stems that lost -ed or -ing in '+'.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M1 = f"'^({_C})?{_V}{_C}'"
_ONE = f"'^({_C})?{_V}{_C}({_V})?$'"
_M2 = f"'^({_C})?{_V}{_C}{_V}{_C}'"
_SHORT = "'([^aeiouy]|^y|[aeiou]y)[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {pattern})"


def ending(x: str, suffixes) -> str:
    return f"regexp_extract({x}, '^.*?({'|'.join(suffixes)})$', 1)"


def swapped(table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    stem = "left(x, length(x) - length(suf))"
    measured = f"({stem} || CASE WHEN suf = 'logi' THEN 'l' ELSE '' END)"
    return f"CASE WHEN suf <> '' AND {has(measured, _M1)} THEN {stem} || CASE suf {cases} END ELSE x END"


_irregular = " ".join(f"WHEN w = {lit(k)} THEN {lit(v + '!')}" for k, v in fixed.STEM_IRREGULAR.items())
_stem4 = "left(x, length(x) - length(suf))"
STEMS = f"""s0 AS (SELECT w, CASE WHEN length(w) < 4 THEN w || '!' {_irregular} ELSE w END AS x FROM vocab),
s1 AS (SELECT w, CASE WHEN x LIKE '%sses' THEN left(x, -2)
  WHEN x LIKE '%ies' THEN CASE WHEN length(x) = 4 THEN left(x, -1) ELSE left(x, -2) END
  WHEN x LIKE '%ss' THEN x WHEN x LIKE '%s' THEN left(x, -1) ELSE x END AS x FROM s0),
s2 AS (SELECT w, CASE WHEN x LIKE '%ied' THEN CASE WHEN length(x) = 4 THEN left(x, -1) ELSE left(x, -2) END
  WHEN x LIKE '%eed' THEN CASE WHEN {has('left(x, -3)', _M1)} THEN left(x, -1) ELSE x END
  WHEN x LIKE '%ed' AND {has('left(x, -2)', f"'^({_C})?[aeiouy]'")} THEN left(x, -2) || '+'
  WHEN x LIKE '%ing' AND {has('left(x, -3)', f"'^({_C})?[aeiouy]'")} THEN left(x, -3) || '+' ELSE x END AS x FROM s1),
s3 AS (SELECT w, CASE WHEN x NOT LIKE '%+' THEN x ELSE CASE
  WHEN {has('left(x, -1)', "'(at|bl|iz)$'")} THEN left(x, -1) || 'e'
  WHEN length(x) >= 3 AND x[-2] = x[-3] AND x[-2] NOT IN ('a','e','i','o','u','y')
    THEN CASE WHEN x[-2] IN ('l','s','z') THEN left(x, -1) ELSE left(x, -2) END
  WHEN {has('left(x, -1)', _ONE)} AND {has('left(x, -1)', _SHORT)} THEN left(x, -1) || 'e'
  ELSE left(x, -1) END END AS x FROM s2),
s4 AS (SELECT w, CASE WHEN {has('x', "'^.+[^aeiouy]y$|^.*[aeiou]yy$'")} THEN left(x, -1) || 'i' ELSE x END AS x FROM s3),
s5 AS (SELECT w, CASE WHEN x LIKE '%alli' AND {has('left(x, -4)', _M1)} THEN left(x, -2) ELSE x END AS x FROM s4),
s6 AS (SELECT w, {swapped(fixed.STEM_DOUBLE)} AS x FROM (SELECT *, {ending('x', fixed.STEM_DOUBLE)} AS suf FROM s5)),
s7 AS (SELECT w, {swapped(fixed.STEM_DERIVED)} AS x FROM (SELECT *, {ending('x', fixed.STEM_DERIVED)} AS suf FROM s6)),
s8 AS (SELECT w, CASE WHEN suf <> '' AND {has(_stem4, _M2)} AND (suf <> 'ion' OR {has(_stem4, "'[st]$'")})
  THEN {_stem4} ELSE x END AS x FROM (SELECT *, {ending('x', fixed.STEM_RESIDUAL)} AS suf FROM s7)),
s9 AS (SELECT w, CASE WHEN x LIKE '%e' AND ({has('left(x, -1)', _M2)} OR ({has('left(x, -1)', _ONE)}
  AND NOT {has('left(x, -1)', _SHORT)})) THEN left(x, -1) ELSE x END AS x FROM s8),
s10 AS (SELECT w, CASE WHEN x LIKE '%ll' AND {has('left(x, -1)', _M2)} THEN left(x, -1) ELSE x END AS x FROM s9),
stems AS (SELECT w, rtrim(x, '!') AS stem FROM s10)"""

ORACLES["stem_tokens"] = f"""WITH words AS (
  SELECT doc_id, unnest({rouge_toks('text')}) AS w, generate_subscripts({rouge_toks('text')}, 1) AS pos FROM documents),
vocab AS (SELECT DISTINCT w FROM words), {STEMS},
joined AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS text, count(*) AS n FROM words JOIN stems USING (w) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, md5(coalesce(j.text, '')) AS stems_md5 FROM documents LEFT JOIN joined j USING (doc_id)"""

ORACLES["rouge_best_ref"] = f"""WITH {ANSWERS}, refs AS (
  SELECT sample_id, answer, unnest(target) AS ref, generate_subscripts(target, 1) AS place FROM answers),
sides AS (SELECT sample_id, 0 AS place, answer AS t FROM answers UNION ALL SELECT sample_id, place, ref FROM refs),
words AS (SELECT sample_id, place, unnest({rouge_toks('t')}) AS w, generate_subscripts({rouge_toks('t')}, 1) AS pos FROM sides),
vocab AS (SELECT DISTINCT w FROM words), {STEMS},
lists AS (SELECT sample_id, place, list(stem ORDER BY pos) AS toks FROM words JOIN stems USING (w) GROUP BY sample_id, place),
pairs AS (SELECT r.sample_id, coalesce(g.toks, []) AS g, coalesce(p.toks, []) AS p FROM refs r
  LEFT JOIN lists g ON g.sample_id = r.sample_id AND g.place = r.place
  LEFT JOIN lists p ON p.sample_id = r.sample_id AND p.place = 0)
SELECT sample_id, round(max({harmonic(common_length('p', 'g'), 'len(g)', 'len(p)')}), 6) AS rouge FROM pairs GROUP BY sample_id"""
