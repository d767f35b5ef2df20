"""The registered queries as DuckDB SQL, built step by step from the same data.

The SQL goes its own way wherever it can: patterns run in their original form
(RE2's ``\\b`` is ASCII as it has to be), matching is one select per lexicon
entry, and hits are grouped and ranked relationally.
"""

from __future__ import annotations

from lumenward.functions.dialect import ANY_CHAR
from lumenward.functions.languages import (
    COUNTED_WORDS, LOCAL_SOURCE, NAMES, REMOTE_DETECTOR, SCRIPTS, STOPWORDS, TOKEN,
)
from lumenward.functions.lexicon import CATEGORIES, ENTRIES
from lumenward.functions.text import WHITESPACE
from lumenward.functions.wording import (
    ACTIONS, DEFAULT_ACTION, DIGEST_EMPTY, DIGEST_FOOT, DIGEST_HEAD, SENDERS,
)
from lumenward.operators.normalize import REFUSAL, SANCTIONED_SOURCES
from workload.phrases import PHRASES, SHORT_TEXTS
from workload.tables import SOURCES


def _q(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _re2(java_class: str) -> str:
    """\\uXXXX escapes as RE2 writes them."""
    out = java_class
    while "\\u" in out:
        at = out.index("\\u")
        out = out[:at] + "\\x{" + out[at + 2:at + 6] + "}" + out[at + 6:]
    return out


_WS = _re2(WHITESPACE)
_SPACES = f"'[{_WS}]+'"
_CASE = {True: "i", False: "-i"}


def _pattern(entry) -> str:
    return f"(?{_CASE[entry.ignore_case]}:" + (
        entry.pattern.replace(".*", _re2(ANY_CHAR) + "*").replace(r"\s", f"[{_WS}]")) + ")"


def _names(code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in NAMES) + f" ELSE {code} END"


def _round2(value: str) -> str:
    return f"(floor(({value}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE)"


# ---- messages ----

def _dressed(key: str) -> str:
    n = len(PHRASES)
    return (f"{_list(PHRASES)}[({key}) % {n} + 1] || ' ' || text || '. ' || "
            f"{_list(PHRASES)}[(({key}) * 7 + ({key}) // {n} + 11) % {n} + 1]")


_RAW_DOCUMENTS = f"""raw AS (
  SELECT doc_id, [doc_id] AS key, CASE WHEN doc_id % 11 <> 0 THEN 'd' || doc_id END AS id,
    {_dressed('doc_id')} AS text,
    ['incoming', 'outgoing', 'OUTGOING', NULL][doc_id % 4 + 1] AS direction,
    ['mutual', 'not-mutual', 'unknown', 'bogus', NULL][(doc_id // 3) % 5 + 1] AS relationship,
    ['instagram', '', NULL][doc_id % 3 + 1] AS platform,
    {_list((*SOURCES, None))}[doc_id % 10 + 1] AS source,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 37 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS ts
  FROM documents)"""

# Of every seventeen messages one has no time, one none that can be read and one a time far ahead.
_FORM = "(conv_id * 5 + turn) % 17"
_RAW_CONVERSATIONS = f"""raw AS (
  SELECT conv_id, turn, [conv_id, turn] AS key, 'c' || conv_id || '-' || turn AS id,
    {_dressed('conv_id * 5 + turn')} AS text,
    CASE WHEN role = 'user' THEN 'outgoing' ELSE 'incoming' END AS direction,
    ['mutual', 'not-mutual', 'unknown'][conv_id % 3 + 1] AS relationship,
    'chat' AS platform, CASE WHEN (conv_id * 3 + turn) % 13 = 0 THEN 'scraping' ELSE 'family-link' END AS source,
    CASE WHEN {_FORM} NOT IN (0, 1, 6)
      THEN TIMESTAMP '2024-01-01' + to_minutes(CAST((conv_id * 90 + turn) % 720000 AS BIGINT)) END AS ts,
    CASE {_FORM} WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' WHEN 6 THEN 'future' END AS undated,
    CASE WHEN {_FORM} = 6 THEN TIMESTAMP '2999-01-01' ELSE ts END AS given_ts
  FROM conversations)"""

_RAW_PLAIN = """raw AS (
  SELECT doc_id, [doc_id] AS key, NULL AS id, text, 'incoming' AS direction, 'unknown' AS relationship,
    NULL AS platform, NULL AS source, '' AS ts
  FROM documents)"""

_SANCTIONED = f"(source IS NULL OR source IN ('', {', '.join(_q(s) for s in SANCTIONED_SOURCES)}))"

_MESSAGES = f"""msg AS (
  SELECT * EXCLUDE (direction, relationship, platform, source),
    CASE WHEN direction = 'outgoing' THEN 'outgoing' ELSE 'incoming' END AS direction,
    CASE WHEN relationship IN ('mutual', 'not-mutual') THEN relationship ELSE 'unknown' END AS relationship,
    coalesce(nullif(platform, ''), 'unknown') AS platform,
    coalesce(nullif(source, ''), 'manual') AS source
  FROM raw WHERE {_SANCTIONED})"""

# ---- language ----

_SCRIPT = "CASE " + " ".join(
    f"WHEN regexp_matches(text, '[{chr(low)}-{chr(high)}]') THEN '{code}'" for code, _, low, high in SCRIPTS) + " END"
_SCRIPT_NAME = "CASE script " + " ".join(f"WHEN '{code}' THEN '{name}'" for code, name, *_ in SCRIPTS) + " END"

_WORDS = f"""scripted AS (SELECT *, {_SCRIPT} AS script FROM msg),
words AS (
  SELECT key, CASE WHEN script IS NULL THEN regexp_extract_all(lower(text), {_q(TOKEN)}) ELSE [] END AS words
  FROM scripted)"""

_STOPWORD_ROWS = ", ".join(
    f"({i}, '{lang}', {_q(word)})" for i, lang in enumerate(STOPWORDS) for word in COUNTED_WORDS[lang])

_SCORES = f"""{_WORDS},
stop(lang_ord, lang, word) AS (VALUES {_STOPWORD_ROWS}),
langs AS (SELECT DISTINCT lang_ord, lang FROM stop),
word_rows AS (SELECT key, unnest(words) AS word FROM words),
counted AS (
  SELECT key, lang, count(*) AS hits FROM word_rows JOIN stop USING (word) GROUP BY key, lang),
scores AS (
  SELECT w.key, len(w.words) AS n_words, l.lang_ord, l.lang, coalesce(c.hits, 0) AS hits
  FROM words w CROSS JOIN langs l LEFT JOIN counted c ON c.key = w.key AND c.lang = l.lang)"""

_LANGUAGE = f"""{_SCORES},
best AS (
  SELECT key, any_value(n_words) AS n_words, max(hits) AS best, sum(hits) AS total,
    arg_max(lang, hits * 10 - lang_ord) AS lang
  FROM scores GROUP BY key),
local_lang AS (
  SELECT s.* EXCLUDE (script),
    CASE WHEN script IS NOT NULL THEN script WHEN n_words = 0 THEN 'und' WHEN best = 0 THEN 'en'
      ELSE lang END AS language,
    coalesce({_SCRIPT_NAME}, CASE WHEN n_words = 0 THEN 'Undetermined' WHEN best = 0 THEN 'English'
      ELSE {_names('lang')} END) AS language_name,
    CASE WHEN script IS NOT NULL THEN 0.95::DOUBLE WHEN n_words = 0 THEN 0::DOUBLE
      WHEN best = 0 THEN 0.3::DOUBLE
      ELSE {_round2('least(0.95::DOUBLE, 0.4::DOUBLE + best::DOUBLE / n_words::DOUBLE * 2::DOUBLE'
                    ' + best::DOUBLE / greatest(total, 1)::DOUBLE * 0.2::DOUBLE)')} END AS language_conf,
    NULL::VARCHAR AS language_source, NULL::VARCHAR AS fallback
  FROM scripted s JOIN best USING (key))"""

_LOCAL = f"{_LANGUAGE}, lang AS (SELECT * FROM local_lang)"
_LOCAL_NAMED = f"{_LANGUAGE}, lang AS (SELECT * REPLACE ('{LOCAL_SOURCE}' AS language_source) FROM local_lang)"

_CANDIDATES = """candidate_rows AS (
  SELECT 'd' || doc_id AS id, unnest([
      {'code': 'pt-BR', 'score': (doc_id % 100) / 100::DOUBLE, 'place': 0},
      {'code': upper(lang), 'score': (n_chars % 97) / 100::DOUBLE, 'place': 1},
      {'code': lang || '-XX', 'score': (doc_id % 100) / 100::DOUBLE, 'place': 2}]) AS c
  FROM documents JOIN labels USING (doc_id) WHERE quality <> 0 AND doc_id % 29 <> 0
  UNION ALL
  SELECT 'd' || doc_id, {'code': ['', NULL, 'it-IT', 'it-IT'][doc_id % 4 + 1], 'score': (doc_id % 89) / 100::DOUBLE, 'place': 0}
  FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 = 0),
picked AS (
  SELECT id, c.code AS code, c.score AS score FROM candidate_rows
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY c.score DESC, c.place, c.code DESC NULLS LAST) = 1),
answers AS (
  SELECT id, coalesce(nullif(code, ''), 'und') AS code, score FROM picked
  UNION ALL
  SELECT DISTINCT 'd' || doc_id, 'und', 0::DOUBLE FROM labels JOIN documents USING (doc_id)
  WHERE quality = 0 AND doc_id % 29 <> 0 AND 'd' || doc_id NOT IN (SELECT id FROM picked))"""

_REMOTE = f"""{_LANGUAGE}, {_CANDIDATES},
labelled AS (
  SELECT l.*, b.score, split_part(b.code, '-', 1) AS code, NOT regexp_matches(l.text, '[^{_WS}]') AS blank,
    b.code IS NULL AND regexp_matches(l.text, '[^{_WS}]') AS is_local
  FROM local_lang l LEFT JOIN answers b ON b.id = l.id),
lang AS (
  SELECT * EXCLUDE (score, code, blank, is_local) REPLACE (
    CASE WHEN blank THEN 'und' WHEN is_local THEN language ELSE code END AS language,
    CASE WHEN blank THEN 'Undetermined' WHEN is_local THEN language_name ELSE {_names('code')} END AS language_name,
    CASE WHEN blank THEN 0::DOUBLE WHEN is_local THEN language_conf ELSE {_round2('score')} END AS language_conf,
    CASE WHEN is_local THEN '{LOCAL_SOURCE}' ELSE '{REMOTE_DETECTOR}' END AS language_source,
    CASE WHEN is_local THEN '{REMOTE_DETECTOR} unavailable: no label for this message' END AS fallback)
  FROM labelled)"""

# ---- matching and scoring ----


def _hits(relation: str, gated: bool) -> str:
    selects = []
    for e in ENTRIES:
        pattern = _q(_pattern(e))
        before = _q(f"(?s)^(.*?)(?-s:{_pattern(e)})")
        where = [f"regexp_matches(text, {pattern})"]
        if e.category == "self-harm":
            where.append("direction = 'outgoing'")
        if gated:
            where.append(f"(language_conf < 0.5::DOUBLE OR '{e.lang}' IN ('any', 'en', language))")
        selects.append(
            f"SELECT key, {e.ord} AS ord, '{e.category}' AS category, {_q(e.signal)}::VARCHAR AS signal,"
            f" '{e.lang}' AS lang, {e.weight}::DOUBLE AS weight,"
            f" length(regexp_extract(text, {before}, 1)) AS start_pos,"
            f" length(regexp_extract(text, {before}, 1)) + length(regexp_extract(text, {pattern})) AS end_pos"
            f" FROM {relation} WHERE {' AND '.join(where)}")
    return "hits AS (" + "\nUNION ALL ".join(selects) + ")"


_CATEGORY_ROWS = ", ".join(f"({i}, '{code}', '{label}')" for i, (code, label) in enumerate(CATEGORIES))

_BUCKETS = f"""cats(cat_ord, category, label) AS (VALUES {_CATEGORY_ROWS}),
signal_rows AS (
  SELECT key, category, signal, min(ord) AS ord FROM hits WHERE signal IS NOT NULL GROUP BY key, category, signal),
signals AS (
  SELECT key, category, string_agg(signal, ',' ORDER BY ord) AS signals FROM signal_rows GROUP BY key, category),
buckets AS (
  SELECT h.key, h.category, list(weight ORDER BY ord) AS weights, coalesce(any_value(s.signals), '') AS signals,
    arg_min(start_pos, start_pos * 100 + ord) AS first_start, arg_min(end_pos, start_pos * 100 + ord) AS first_end,
    arg_min(lang, ord) FILTER (WHERE lang NOT IN ('any', 'en')) AS hint
  FROM hits h LEFT JOIN signals s ON s.key = h.key AND s.category = h.category
  GROUP BY h.key, h.category)"""

_COMBINED = ("(1::DOUBLE - list_reduce(list_prepend(1::DOUBLE, weights),"
             " lambda rest, w: rest * (1::DOUBLE - w)))")

_SCORED = f"""{_BUCKETS},
combined AS (
  SELECT b.*, cat_ord, label, l.* EXCLUDE (key), {_COMBINED} AS combined
  FROM buckets b JOIN cats USING (category) JOIN lang l ON l.key = b.key),
confident AS (
  SELECT *, least(0.99::DOUBLE, {_round2('''CASE
      WHEN category IN ('grooming', 'sexual-solicitation') AND relationship = 'not-mutual'
        THEN 1::DOUBLE - (1::DOUBLE - combined) * (1::DOUBLE - 0.2::DOUBLE)
      WHEN category IN ('grooming', 'sexual-solicitation') AND relationship = 'mutual'
        THEN combined * 0.9::DOUBLE
      ELSE combined END''')}) AS confidence
  FROM combined)"""


def _part(start: str, end: str) -> str:
    return f"regexp_replace(substring(text, {start} + 1, ({end}) - ({start})), {_SPACES}, ' ', 'g')"


_LO, _HI = "greatest(0, first_start - 22)", "least(length(text), first_end + 22)"
_EXCERPT = (f"trim(CASE WHEN {_LO} > 0 THEN '…' ELSE '' END || {_part(_LO, 'first_start')} || '▇▇▇' || "
            f"{_part('first_end', _HI)} || CASE WHEN {_HI} < length(text) THEN '…' ELSE '' END)")

_SENDER = "CASE relationship " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in SENDERS) + " END"
_ACTION = "CASE category || tier " + " ".join(
    f"WHEN '{c}{t}' THEN {_q(text)}" for c, t, text in ACTIONS) + f" ELSE {_q(DEFAULT_ACTION)} END"
_CONF = "printf('%.2f', confidence)"

_FINDINGS = f"""{_SCORED},
findings AS (
  SELECT *, CASE WHEN language_conf < 0.5::DOUBLE AND hint IS NOT NULL THEN hint ELSE language END AS reported,
    {_EXCERPT} AS excerpt, CASE WHEN confidence >= 0.7::DOUBLE THEN 'immediate' ELSE 'review' END AS tier,
    row_number() OVER (PARTITION BY key ORDER BY confidence DESC, cat_ord) AS rank
  FROM confident WHERE confidence >= 0.45::DOUBLE),
worded AS (
  SELECT *, '"' || excerpt || '" · ' || {_SENDER} AS context, {_ACTION} AS action FROM findings),
texts AS (
  SELECT *, 'DETECTED: ' || category || ' | ' || reported || ' | ' || {_CONF} || chr(10)
      || 'CONTEXT: ' || context || chr(10) || 'SUGGESTED ACTION: ' || action AS alert,
    '. ' || label || ' (' || reported || ', ' || {_CONF} || ') — ' || context AS item,
    row_number() OVER (PARTITION BY key, tier ORDER BY rank) AS tier_rank,
    row_number() OVER (PARTITION BY tier ORDER BY key, rank) AS stream_no
  FROM worded)"""

_DOCUMENTS = f"WITH {_RAW_DOCUMENTS}, {_MESSAGES}"
_CONVERSATIONS = f"WITH {_RAW_CONVERSATIONS}, {_MESSAGES}"
_GATED = _hits("lang", gated=True)
_DOC_HITS = f"{_DOCUMENTS}, {_LOCAL}, {_GATED}"
_DOC_REMOTE = f"{_DOCUMENTS}, {_REMOTE}, {_GATED}, {_FINDINGS}"
_DOC_FINDINGS = f"{_DOC_HITS}, {_FINDINGS}"
_CONV_FINDINGS = f"{_CONVERSATIONS}, {_LOCAL}, {_GATED}, {_FINDINGS}"

_HIT_COLUMNS = ("key[1] AS doc_id, ord::INTEGER AS ord, category, signal, lang, weight,"
                " start_pos::INTEGER AS start_pos, end_pos::INTEGER AS end_pos")
_FINDING_COLUMNS = f"""key[1] AS doc_id, category, label, confidence, reported AS language,
  {_names('reported')} AS "languageName", excerpt, signals, relationship AS "senderRelationship", direction"""


def _digest(period: str) -> str:
    head = (f"CASE WHEN count(*) = 0 THEN {_q(period + DIGEST_EMPTY)}"
            f" ELSE {_q(period + DIGEST_HEAD[0])} || count(*) || {_q(DIGEST_HEAD[1])} END")
    return f"""digest AS (
  SELECT stream_no::BIGINT AS line_no, '  ' || stream_no || item AS line FROM texts WHERE tier = 'review'
  UNION ALL SELECT 0::BIGINT, {head} FROM texts WHERE tier = 'review'
  UNION ALL SELECT count(*) + 1, {_q(DIGEST_FOOT)} FROM texts WHERE tier = 'review' HAVING count(*) > 0)"""


def _per_message(*extra: str) -> str:
    more = "".join(f", {e}" for e in extra)
    return f"""SELECT l.doc_id, l.id, l.platform, l.direction, l.ts AS "timestamp", l.language,
      l.language_name AS "languageName", count(t.tier) FILTER (WHERE t.tier = 'immediate')::INTEGER AS n_immediate,
      count(t.tier) FILTER (WHERE t.tier = 'review')::INTEGER AS n_batch,
      coalesce(string_agg(t.category, ',' ORDER BY t.rank) FILTER (WHERE t.tier = 'immediate'), '')
        AS immediate_categories,
      coalesce(string_agg(t.category, ',' ORDER BY t.rank) FILTER (WHERE t.tier = 'review'), '')
        AS batch_categories,
      coalesce(string_agg(t.alert, chr(10) || chr(10) ORDER BY t.rank) FILTER (WHERE t.tier = 'immediate'), '')
        AS alerts{more}
    FROM lang l LEFT JOIN texts t ON t.key = l.key GROUP BY ALL"""


_REFUSED = (f"{_q(REFUSAL[0])} || source || "
            f"{_q(REFUSAL[1] + ', '.join(SANCTIONED_SOURCES) + REFUSAL[2])}")

_DAY_COUNTS = """SELECT strftime(l.ts, '%Y-%m-%d') AS day, count(DISTINCT l.key) AS messages,
    count(t.tier) FILTER (WHERE t.tier = 'immediate') AS immediate,
    count(t.tier) FILTER (WHERE t.tier = 'review') AS batched
  FROM lang l LEFT JOIN texts t ON t.key = l.key GROUP BY 1"""

_REPORT = f"""{_digest('DAILY')},
  tiers AS (SELECT count(*) FILTER (WHERE tier = 'immediate') AS i, count(*) FILTER (WHERE tier = 'review') AS b FROM texts),
  report AS (
    SELECT 0 AS section, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, 0::BIGINT AS line_no,
      'Scanned ' || (SELECT count(*) FROM lang) || ' message(s): ' || i || ' immediate, ' || b || ' batched.'
        AS line FROM tiers
    UNION ALL SELECT 1, NULL, NULL, 0, chr(10) || '══ IMMEDIATE ALERTS ══' FROM tiers WHERE i > 0
    UNION ALL SELECT 2, key[1], key[2], tier_rank, chr(10) || alert FROM texts WHERE tier = 'immediate'
    UNION ALL SELECT 3, NULL, NULL, line_no, CASE WHEN line_no = 0 THEN chr(10) ELSE '' END || line FROM digest)"""

def _digests(items: str, days: str, label: str = "DAILY", day: str = "period") -> str:
    """A digest for each of ``days``, of ``items`` with (day, item, key, rank)."""
    return f"""days AS ({days}), items AS ({items}),
numbered AS (SELECT day, item, row_number() OVER (PARTITION BY day ORDER BY key, rank) AS no FROM items SEMI JOIN days USING (day)),
sizes AS (SELECT d.day, count(n.no) AS n FROM days d LEFT JOIN numbered n USING (day) GROUP BY 1)
SELECT day::VARCHAR AS {day}, no::BIGINT AS line_no, '  ' || no || item AS line FROM numbered
UNION ALL SELECT day::VARCHAR, 0, CASE WHEN n = 0 THEN {_q(label + DIGEST_EMPTY)}
  ELSE {_q(label + DIGEST_HEAD[0])} || n || {_q(DIGEST_HEAD[1])} END FROM sizes
UNION ALL SELECT day::VARCHAR, n + 1, {_q(DIGEST_FOOT)} FROM sizes WHERE n > 0"""


_TOKYO_DAY = "CAST(ts + INTERVAL 9 HOUR AS DATE)"
_WEEK = "CAST(date_trunc('week', ts) AS DATE)"


def _period_digests(period: str, label: str) -> str:
    return _digests(f"SELECT {period} AS day, item, key, rank FROM texts WHERE tier = 'review' AND ts IS NOT NULL",
                    f"SELECT DISTINCT {period} AS day FROM lang WHERE ts IS NOT NULL", label)


# Messages that come in two goes; a day is closed an hour after its end, by the latest message.
_ARRIVED = """arrived AS (
  SELECT key, CAST(ts AS DATE) AS day, (key[1] + key[2]) % 5 = 0 AS second, ts FROM lang),
closed AS (SELECT *, max(ts) FILTER (NOT second) OVER () - INTERVAL 1 HOUR AS w1, max(ts) OVER () - INTERVAL 1 HOUR AS w2 FROM arrived),
fated AS (
  SELECT key, day, ts, CASE WHEN ts IS NULL THEN 'undated' WHEN second AND day + INTERVAL 1 DAY <= w1 THEN 'late' ELSE 'counted' END AS fate,
    day + INTERVAL 1 DAY <= w2 AS over FROM closed)"""


def _span_excerpt(context: int, most: int) -> str:
    lo, hi = f"greatest(0, first - {context})", f"least(length(text), last + {context})"
    around = (f"trim(CASE WHEN {lo} > 0 THEN '…' ELSE '' END || {_part(lo, 'first')} || '▇▇▇' || {_part('last', hi)}"
              f" || CASE WHEN {hi} < length(text) THEN '…' ELSE '' END)")
    head = f"trim({_part('0', str(context))})"
    return (f"CASE WHEN first >= 0 AND last <= length(text) AND first < last THEN"
            f" CASE WHEN length({around}) > {most} THEN rtrim(substring({around}, 1, {most - 1})) || '…' ELSE {around} END"
            f" WHEN {head} = '' THEN '▇▇▇' ELSE {head} || ' ▇▇▇' END")


_RAW_PHRASES = f"""raw AS (
  SELECT doc_id, [doc_id] AS key, NULL AS id, coalesce({_list((*PHRASES, *SHORT_TEXTS))}[doc_id % {len(PHRASES) + len(SHORT_TEXTS)} + 1]
    || ' ' || CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '\\p{{L}}+', '', 'g')
      ELSE regexp_replace(text, '[^ \\n]+', ' ', 'g') END, '') AS text, 'incoming' AS direction, 'unknown' AS relationship, NULL AS platform, NULL AS source, '' AS ts
  FROM documents)"""

# What each odd line comes to: whether it is bad, its id, whether it holds the text, its platform.
_ODD = """odd(form, bad, has_id, has_text) AS (VALUES (0, false, 0, 1), (1, false, 1, 1), (2, false, 1, 1), (3, false, 1, 1),
  (4, false, 0, 0), (5, false, 0, 0), (6, false, 0, 0), (7, false, 0, 0), (8, false, 1, 2), (9, false, 2, 1),
  (10, true, 0, 0), (11, true, 0, 0), (12, true, 0, 0), (13, true, 0, 0), (16, false, 1, 1), (17, false, 1, 1),
  (18, false, 1, 1), (19, false, 1, 1), (20, false, 3, 1), (21, true, 0, 0))"""

_STREAM_ALERTS = "(tier_rank - 1)::INTEGER AS place, alert FROM texts WHERE tier = 'immediate'"

ORACLE_SQL = {
    "normalize_messages": f"""{_DOCUMENTS} SELECT doc_id, id, text, direction,
        relationship AS "senderRelationship", platform, source, ts AS "timestamp" FROM msg""",
    "accepted_sources": f"WITH {_RAW_DOCUMENTS} SELECT doc_id, source FROM raw WHERE {_SANCTIONED}",
    "refused_sources": f"""WITH {_RAW_DOCUMENTS} SELECT doc_id, source, {_REFUSED} AS reason
        FROM raw WHERE NOT {_SANCTIONED}""",
    "strict_guard": f"""WITH {_RAW_CONVERSATIONS} SELECT count(*) FILTER (WHERE {_SANCTIONED}) AS kept,
        any_value({_REFUSED}) FILTER (WHERE NOT {_SANCTIONED}) AS reason FROM raw""",
    "script_detect": f"{_DOCUMENTS}, {_WORDS} SELECT doc_id, script, {_SCRIPT_NAME} AS script_name FROM scripted",
    "tokens": f"""{_DOCUMENTS}, {_WORDS} SELECT key[1] AS doc_id, len(words)::INTEGER AS n_words,
        md5(array_to_string(words, ' ')) AS words_md5 FROM words""",
    "stopword_scores": f"""{_DOCUMENTS}, {_SCORES}
        SELECT key[1] AS doc_id, n_words::INTEGER AS n_words, lang, hits::INTEGER AS hits FROM scores""",
    "detect_language": f"""{_DOCUMENTS}, {_LOCAL} SELECT doc_id, language, language_name AS "languageName",
        language_conf AS "languageConfidence" FROM lang""",
    "language_vs_label": f"""WITH {_RAW_PLAIN}, {_MESSAGES}, {_LOCAL}
        SELECT d.lang, l.language, count(*) AS documents,
          count(*) FILTER (WHERE l.language_conf < 0.5::DOUBLE) AS unsure
        FROM lang l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2""",
    "remote_language_enrich": f"""{_DOCUMENTS}, {_REMOTE} SELECT doc_id, language,
        language_name AS "languageName", language_conf AS "languageConfidence",
        language_source AS "languageSource", fallback FROM lang""",
    "lexicon_hits": f"{_DOCUMENTS}, {_hits('msg', gated=False)} SELECT {_HIT_COLUMNS} FROM hits",
    "hits_gated": f"{_DOC_HITS} SELECT {_HIT_COLUMNS} FROM hits",
    "category_buckets": f"""{_DOC_HITS}, {_BUCKETS} SELECT key[1] AS doc_id, category,
        array_to_string(list_transform(weights, lambda w: printf('%.2f', w)), ',') AS weights, signals,
        first_start::INTEGER AS first_start, first_end::INTEGER AS first_end, hint FROM buckets""",
    "category_confidence": f"""{_DOC_HITS}, {_SCORED}
        SELECT key[1] AS doc_id, category, combined, confidence FROM confident""",
    "findings": f"{_DOC_FINDINGS} SELECT {_FINDING_COLUMNS} FROM findings",
    "findings_ranked": f"""{_DOC_FINDINGS}
        SELECT key[1] AS doc_id, rank::INTEGER AS rank, category, confidence FROM findings""",
    "redacted_excerpts": f"""{_DOC_FINDINGS} SELECT key[1] AS doc_id, category, excerpt,
        length(excerpt)::INTEGER AS excerpt_chars FROM findings""",
    "classify_remote": f"{_DOC_REMOTE} SELECT {_FINDING_COLUMNS} FROM findings",
    "classify_stored": f"{_DOC_REMOTE} SELECT {_FINDING_COLUMNS} FROM findings",
    "route_tiers": f"{_DOC_FINDINGS} SELECT category, tier, count(*) AS findings FROM findings GROUP BY 1, 2",
    "suggested_actions": f"{_DOC_FINDINGS} SELECT key[1] AS doc_id, category, action, context FROM texts",
    "formatted_alerts": f"""{_DOC_FINDINGS} SELECT key[1] AS doc_id, tier_rank::INTEGER AS rank, alert
        FROM texts WHERE tier = 'immediate'""",
    "finding_texts": f"{_DOC_FINDINGS} SELECT key[1] AS doc_id, category, alert FROM texts",
    "digest_items": f"""{_DOC_FINDINGS} SELECT key[1] AS doc_id, tier_rank::INTEGER AS rank,
        '  ' || tier_rank || item AS line FROM texts WHERE tier = 'review'""",
    "digest_lines": f"{_DOC_FINDINGS}, {_digest('WEEKLY')} SELECT line_no, line FROM digest",
    "digest_text": f"""{_CONV_FINDINGS}, {_digest('DAILY')}
        SELECT line_no // 100 AS page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM digest GROUP BY 1""",
    "digest_per_message": f"""{_DOC_FINDINGS}, items AS (
          SELECT key, count(*) AS n, string_agg('  ' || tier_rank || item, chr(10) ORDER BY rank) AS lines
          FROM texts WHERE tier = 'review' GROUP BY key)
        SELECT doc_id, CASE WHEN n IS NULL THEN {_q('DAILY' + DIGEST_EMPTY)}
          ELSE {_q('DAILY' + DIGEST_HEAD[0])} || n || {_q(DIGEST_HEAD[1])} || chr(10) || lines || chr(10)
            || {_q(DIGEST_FOOT)} END AS digest
        FROM lang LEFT JOIN items USING (key)""",
    "stream_counts": f"""{_DOC_FINDINGS} SELECT (SELECT count(*) FROM lang) AS messages,
        count(*) FILTER (WHERE tier = 'immediate') AS immediate,
        count(*) FILTER (WHERE tier = 'review') AS batched FROM findings""",
    "process_messages": f"{_DOC_FINDINGS} {_per_message()}",
    "process_messages_local": f"""{_DOCUMENTS}, {_LOCAL_NAMED}, {_GATED}, {_FINDINGS}
        {_per_message('l.language_source AS "languageSource"', 'l.fallback')}""",
    "process_messages_remote": f"""{_DOC_REMOTE}
        {_per_message('l.language_source AS "languageSource"', 'l.fallback')}""",
    "stream_report": f"{_CONV_FINDINGS}, {_REPORT} SELECT * FROM report",
    "job_text_report": f"""{_CONV_FINDINGS}, {_REPORT}, split AS (
          SELECT section, conv_id, turn, line_no, unnest(parts) AS line, generate_subscripts(parts, 1) AS part
          FROM (SELECT *, string_split(line, chr(10)) AS parts FROM report))
        SELECT row_number() OVER (ORDER BY section, conv_id, turn, line_no, part) AS line_no, line FROM split""",
    "job_json_results": f"""{_CONV_FINDINGS} SELECT id, language, immediate_categories, alerts
        FROM ({_per_message().replace('l.doc_id, ', '')})""",
    "job_refused": f"WITH {_RAW_CONVERSATIONS} SELECT id, source, {_REFUSED} AS reason FROM raw WHERE NOT {_SANCTIONED}",
    "daily_digests": f"{_CONV_FINDINGS}, {_period_digests(_TOKYO_DAY, 'DAILY')}",
    "weekly_digests": f"{_CONV_FINDINGS}, {_period_digests(_WEEK, 'WEEKLY')}",
    "stream_daily_digest": f"{_CONV_FINDINGS}, {_ARRIVED}, " + _digests(
        """SELECT f.day, item, t.key, rank FROM texts t JOIN fated f ON f.key = t.key WHERE tier = 'review' AND fate = 'counted'""",
        "SELECT DISTINCT day FROM fated WHERE fate = 'counted' AND over", "DAILY", "day"),
    "stream_late": f"""{_CONV_FINDINGS}, {_ARRIVED} SELECT f.key[1] AS conv_id, f.key[2] AS turn, l.id, f.day::VARCHAR AS day,
          count(t.tier) FILTER (WHERE t.tier = 'immediate')::INTEGER AS immediate,
          count(t.tier) FILTER (WHERE t.tier = 'review')::INTEGER AS batched,
          coalesce(string_agg(t.category, ',' ORDER BY t.rank) FILTER (WHERE t.tier = 'review'), '') AS categories
        FROM fated f JOIN lang l ON l.key = f.key LEFT JOIN texts t ON t.key = f.key WHERE fate = 'late' GROUP BY ALL""",
    "stream_fates": f"""{_CONV_FINDINGS.replace('FROM conversations)', 'FROM conversations WHERE (conv_id * 10 + turn) % 9 <> 0)')}, {_ARRIVED}
        SELECT fate, count(DISTINCT f.key) AS messages, count(t.tier) FILTER (WHERE t.tier = 'immediate') AS immediate,
          count(t.tier) FILTER (WHERE t.tier = 'review') AS batched FROM fated f LEFT JOIN texts t ON t.key = f.key GROUP BY 1
        UNION ALL SELECT 'refused', count(*), 0, 0 FROM raw WHERE NOT {_SANCTIONED} HAVING count(*) > 0
        UNION ALL SELECT 'bad', count(*), 0, 0 FROM conversations WHERE (conv_id * 10 + turn) % 9 = 0 HAVING count(*) > 0""",
    "redacted_spans": f"""WITH spans AS (SELECT doc_id, text, doc_id * 37 % (length(text) + 20) - 5 AS first,
          doc_id * 37 % (length(text) + 20) - 5 + doc_id % 40 - 3 AS last FROM documents)
        SELECT doc_id, {_span_excerpt(22, 70)} AS excerpt, {_span_excerpt(60, 70)} AS wide, {_span_excerpt(60, 1000)} AS long
        FROM spans""",
    "phrase_language": f"""WITH {_RAW_PHRASES}, {_MESSAGES}, {_LOCAL} SELECT doc_id, language,
        language_name AS "languageName", language_conf AS "languageConfidence" FROM lang""",
    "remote_requests": f"""{_DOCUMENTS}, sent AS (
          SELECT doc_id, regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS text FROM msg)
        SELECT doc_id, md5(text) AS text_md5, least(length(text), 5000)::INTEGER AS sent_chars FROM sent WHERE text <> ''""",
    "jsonl_lines": f"""WITH {_RAW_CONVERSATIONS}, {_ODD}, lines AS (
          SELECT o.*, text, conv_id * 10 + turn AS n FROM raw JOIN odd o ON o.form = (conv_id * 10 + turn) % 22)
        SELECT bad, CASE has_id WHEN 1 THEN n::VARCHAR WHEN 2 THEN n || '.5' WHEN 3 THEN (n * 100 + 50)::VARCHAR END AS id,
          md5(CASE has_text WHEN 1 THEN text WHEN 2 THEN '0' ELSE '' END) AS text_md5,
          NULL::VARCHAR AS platform, NULL::VARCHAR AS direction, count(*) AS lines
        FROM lines GROUP BY ALL""",
    "jsonl_rejects": f"""WITH {_RAW_CONVERSATIONS}, kinds AS (
          SELECT (conv_id * 10 + turn) % 22 AS form, conv_id * 10 + turn AS n, to_json(text)::VARCHAR AS t FROM raw),
        bad AS (SELECT CASE form WHEN 10 THEN '{{"id":"' || n || '","text":' || t
            WHEN 11 THEN '{{"id":"' || n || '","text":' || t || '}} x'
            WHEN 12 THEN '{{"id":"' || n || '","text":' || t || '}},{{"id":"y"}}' WHEN 13 THEN 'not json'
            WHEN 21 THEN '{{"id":"' || n || '"}},{{"text":' || t || '}}' || chr(65279) END AS line FROM kinds)
        SELECT line, count(*) AS lines, count(*) AS places FROM bad WHERE line IS NOT NULL GROUP BY 1""",
    "toxicity_precision_recall": f"""WITH {_RAW_PLAIN}, {_MESSAGES}, {_LOCAL}, {_GATED}, {_FINDINGS},
        flagged AS (SELECT DISTINCT key[1] AS doc_id FROM findings WHERE category = 'harassment'),
        judged AS (
          SELECT toxic, f.doc_id IS NOT NULL AS flagged FROM labels b
          JOIN documents d USING (doc_id) LEFT JOIN flagged f USING (doc_id)),
        totals AS (
          SELECT count(*) FILTER (WHERE flagged AND toxic = 1) AS hits,
            count(*) FILTER (WHERE flagged AND toxic = 0) AS false_alarms,
            count(*) FILTER (WHERE NOT flagged AND toxic = 1) AS misses,
            count(*) FILTER (WHERE NOT flagged AND toxic = 0) AS passed FROM judged)
        SELECT *, hits / nullif(hits + false_alarms, 0)::DOUBLE AS precision,
          hits / nullif(hits + misses, 0)::DOUBLE AS recall FROM totals""",
    "daily_digest_counts": f"{_CONV_FINDINGS} {_DAY_COUNTS}",
    "jsonl_round_trip": f"""{_CONV_FINDINGS} SELECT id, language, n_immediate, n_batch, alerts
        FROM ({_per_message().replace('l.doc_id, ', '')})""",
    "stream_alerts": f"{_CONV_FINDINGS} SELECT key[1] AS conv_id, key[2] AS turn, id, {_STREAM_ALERTS}",
    "stream_alerts_jsonl": f"{_CONV_FINDINGS} SELECT id, {_STREAM_ALERTS}",
    "stream_alerts_remote": f"""{_CONVERSATIONS}, {_LANGUAGE}, lang AS (
          SELECT * REPLACE (CASE WHEN turn % 2 = 0 THEN 'de' ELSE language END AS language,
            CASE WHEN turn % 2 = 0 THEN 'German' ELSE language_name END AS language_name,
            CASE WHEN turn % 2 = 0 THEN 0.9::DOUBLE ELSE language_conf END AS language_conf) FROM local_lang),
        {_GATED}, {_FINDINGS} SELECT key[1] AS conv_id, key[2] AS turn, language, {_STREAM_ALERTS}""",
    "stream_alerts_late_labels": f"""{_CONVERSATIONS}, {_LANGUAGE}, lang AS (
          SELECT * REPLACE (CASE WHEN timely THEN 'de' ELSE language END AS language,
            CASE WHEN timely THEN 'German' ELSE language_name END AS language_name,
            CASE WHEN timely THEN 0.9::DOUBLE ELSE language_conf END AS language_conf,
            CASE WHEN timely THEN '{REMOTE_DETECTOR}' ELSE '{LOCAL_SOURCE}' END AS language_source)
          FROM (SELECT *, (conv_id + turn) % 4 IN (1, 2) AS timely FROM local_lang)),
        {_GATED}, {_FINDINGS} SELECT key[1] AS conv_id, key[2] AS turn, language, language_source AS "languageSource", {_STREAM_ALERTS}""",
    "stream_undated": f"""{_CONV_FINDINGS} SELECT key[1] AS conv_id, key[2] AS turn, id, reason,
          immediate::INTEGER AS immediate, batched::INTEGER AS batched FROM (
        SELECT l.key, l.id, l.undated AS reason, count(t.tier) FILTER (WHERE t.tier = 'immediate') AS immediate,
          count(t.tier) FILTER (WHERE t.tier = 'review') AS batched
        FROM lang l LEFT JOIN texts t ON t.key = l.key WHERE l.ts IS NULL GROUP BY ALL)""",
    "stream_refused": f"""WITH {_RAW_CONVERSATIONS} SELECT conv_id, turn, id, source, {_REFUSED} AS reason
        FROM raw WHERE NOT {_SANCTIONED}""",
    "stream_digest_items": f"""{_CONV_FINDINGS} SELECT key[1] AS conv_id, key[2] AS turn, strftime(ts, '%Y-%m-%d') AS day,
        (tier_rank - 1)::INTEGER AS place, category, confidence, excerpt FROM texts WHERE tier = 'review'""",
    "stream_daily_counts": f"""{_CONV_FINDINGS} SELECT * FROM ({_DAY_COUNTS})
        WHERE strptime(day, '%Y-%m-%d') + INTERVAL 1 DAY
          <= (SELECT max(ts) FROM msg) - INTERVAL 1 HOUR""",
}
