"""The same queries as plain SQL, to check the Spark results with DuckDB."""

from __future__ import annotations

import re

from ..functions import vocab
from ..functions.vocab import TRAINING_FIELDS
from ..operators.features import WORD
from .views import AS_OF, VIEWS, view_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def case(key: str, table: dict, default: str | None = None) -> str:
    arms = " ".join(
        f"WHEN {q(k)} THEN {v if isinstance(v, (int, float)) and not isinstance(v, bool) else (str(v).lower() if isinstance(v, bool) else ('NULL' if v is None else q(v)))}"
        for k, v in table.items()
    )
    return f"CASE {key} {arms}" + (f" ELSE {default}" if default else "") + " END"


D = "CAST({} AS DOUBLE)".format
RC = f"CASE WHEN lower(root_cause) IN ({listed(vocab.ROOT_CAUSES)}) THEN lower(root_cause) ELSE 'application_defect' END"


def field(name: str) -> str:
    return case("rc", {c: r[name] for c, r in vocab.PLAYBOOK.items()})


LOCATOR = (
    f"coalesce(CASE WHEN old_locator NOT IN ({listed(vocab.LOCATOR_PLACEHOLDERS)}) THEN old_locator END, "
    + ", ".join(f"nullif(regexp_extract(error_message, {q(p)}), '')" for p in vocab.LOCATOR_PATTERNS)
    + f", {q(vocab.LOCATOR_UNKNOWN)})"
)
WAIT = (
    f"coalesce(CASE WHEN old_locator NOT IN ({listed(vocab.WAIT_PLACEHOLDERS)}) THEN old_locator END, CASE "
    + " ".join(f"WHEN contains(lower(error_message), {q(k.lower())}) THEN {q(k)}" for k in vocab.WAIT_UPGRADES)
    + f" END, {q(vocab.WAIT_UNKNOWN)})"
)


def selector(expr: str) -> str:
    return f"concat('[data-testid=''', lower(trim(regexp_replace({expr}, '[^a-zA-Z0-9]', '-', 'g'), '-')), ''']')"


def new_wait(expr: str) -> str:
    return case(expr, vocab.WAIT_UPGRADES, q(vocab.WAIT_DEFAULT_UPGRADE))


def make_id(prefix: str, key: str, digits: int = 32) -> str:
    return f"concat('{prefix}-', upper(substr(md5({key}), 1, {digits})))"


OLD_DEFAULT = case("rc", vocab.OLD_VALUE_DEFAULTS)
HEAL_FIELDS = "healing_id, repair_type, old_value, new_value, recommendation, status, developer_alert"


def heal_ctes(src: str) -> str:
    """Three steps: gap and cause, old value, result."""
    return f"""
    h1 AS (SELECT *, {RC} AS rc,
        CASE WHEN root_cause IS NULL THEN 'root_cause'
             WHEN error_message IS NULL AND (
                (lower(root_cause) = 'locator_issue' AND (old_locator IS NULL OR old_locator IN ({listed(vocab.LOCATOR_PLACEHOLDERS)})))
                OR (lower(root_cause) = 'synchronization_issue' AND (old_locator IS NULL OR old_locator IN ({listed(vocab.WAIT_PLACEHOLDERS)}))))
             THEN 'error_message' END AS gap FROM {src}),
    h2 AS (SELECT *, CASE rc WHEN 'locator_issue' THEN {LOCATOR}
        WHEN 'synchronization_issue' THEN {WAIT}
        ELSE coalesce(nullif(old_locator, ''), {OLD_DEFAULT}) END AS ov FROM h1),
    healed AS (SELECT * EXCLUDE (rc, gap, ov),
        CASE WHEN gap IS NOT NULL THEN 'H-ERROR' ELSE {make_id('H', 'test_id')} END AS healing_id,
        CASE WHEN gap IS NOT NULL THEN 'N/A' ELSE {field('repair_type')} END AS repair_type,
        CASE WHEN gap IS NOT NULL THEN '' ELSE ov END AS old_value,
        CASE WHEN gap IS NOT NULL THEN '' WHEN rc = 'locator_issue' THEN {selector('ov')}
             WHEN rc = 'synchronization_issue' THEN {new_wait('ov')} ELSE {field('new_value')} END AS new_value,
        CASE WHEN gap IS NOT NULL THEN concat('Healing engine error: missing ', gap) ELSE {field('recommendation')} END AS recommendation,
        CASE WHEN gap IS NOT NULL THEN 'Pending' ELSE {field('status')} END AS status,
        CASE WHEN gap IS NOT NULL THEN false ELSE {field('developer_alert')} END AS developer_alert
        FROM h2)"""


SCORE = f"""CASE WHEN retry_count IS NOT NULL AND severity IS NOT NULL AND test_duration_sec IS NOT NULL THEN
    least(round(least(retry_count / {D(5)}, {D('0.4')})
    + CASE WHEN failure_type IN ({listed(vocab.FLAKY_TYPES)}) THEN {D('0.2')} ELSE {D(0)} END
    + CASE WHEN failure_stage = 'test' THEN {D('0.1')} ELSE {D(0)} END
    + CASE upper(severity) WHEN 'LOW' THEN {D('0.15')} WHEN 'MEDIUM' THEN {D('0.1')} WHEN 'HIGH' THEN {D('0.05')} WHEN 'CRITICAL' THEN {D(0)} ELSE {D('0.05')} END
    + CASE WHEN test_duration_sec > 120 THEN {D('0.1')} WHEN test_duration_sec > 60 THEN {D('0.05')} ELSE {D(0)} END, 4), {D(1)}) END"""
CUT_PERCENT = "concat(CAST(CAST(trunc(score * CAST(100 AS DOUBLE)) AS INTEGER) AS VARCHAR), '%')"
RISK = "CASE WHEN score >= CAST(0.65 AS DOUBLE) THEN 'High' WHEN score >= CAST(0.4 AS DOUBLE) THEN 'Medium' ELSE 'Low' END"
PERCENT = "concat(CAST(CAST(round_even(confidence * CAST(100 AS DOUBLE), 0) AS INTEGER) AS VARCHAR), '%')"


def flaky_ctes(src: str) -> str:
    return f"""
    f1 AS (SELECT *, {SCORE} AS score FROM {src}),
    checked AS (SELECT * EXCLUDE (score),
        coalesce(score >= CAST(0.4 AS DOUBLE), false) AS is_flaky,
        coalesce(score, {D(0)}) AS flaky_probability,
        CASE WHEN score IS NULL THEN 'Unknown' ELSE {RISK} END AS risk_level,
        CASE WHEN score IS NULL THEN '0%' ELSE {CUT_PERCENT} END AS instability_score
        FROM f1)"""


MESSAGE = f"concat('Test ''', test_name, ''' failed with root cause ''', root_cause, ''' (confidence: ', {PERCENT}, '). ', recommendation)"

BY_CAUSE = f"coalesce({case('lower(root_cause)', vocab.CAUSE_TARGETS)}, 'developer')"

CTES = {name: view_sql(name) for name in VIEWS}
CTES["scored"] = f"SELECT id, {SCORE} AS score FROM failures_src"
CTES["failures"] = f"""SELECT id, test_id, test_name, pipeline, 'FAIL' AS status, root_cause, {PERCENT} AS confidence,
    status AS healing, error_message AS logs, stack_trace, recommendation, developer_alert, created_at FROM checked"""
CTES["healing_actions"] = """SELECT id, healing_id, test_id AS failure_test_id, test_name, repair_type, old_value,
    new_value, status FROM checked"""
CTES["flaky_tests"] = """SELECT id, test_id AS test_code, test_name, instability_score, 'N/A' AS recent_pattern,
    risk_level FROM checked WHERE is_flaky"""
CTES["notifications"] = f"""SELECT id, test_id AS failure_test_id, test_name, root_cause, {MESSAGE} AS message,
    'developer' AS target FROM checked WHERE developer_alert"""
CTES["key_list"] = "SELECT concat('TEST-', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS test_id FROM orders WHERE o_orderstatus = 'F'"
CTES["known_keys"] = "SELECT DISTINCT test_id FROM key_list WHERE test_id IN (SELECT test_id FROM failures)"
BY_ID = "CASE id % 6 " + " ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(vocab.ROOT_CAUSES)) + " END"
CTES["predictions"] = f"SELECT root_cause AS label, {BY_ID} AS prediction FROM failures_src"
CTES["second"] = f"SELECT root_cause AS label, CASE WHEN old_locator = '#pay-now' THEN 'locator_issue' ELSE {BY_ID} END AS prediction FROM failures_src"
CTES["classes"] = f"SELECT unnest([{listed(vocab.ROOT_CAUSES)}]) AS class"
CTES["class_table"] = """SELECT class, precision, recall, support, predicted, hits,
    CASE WHEN precision + recall > 0 THEN CAST(2 AS DOUBLE) * precision * recall / (precision + recall) ELSE CAST(0 AS DOUBLE) END AS f1
    FROM (SELECT class, hits, predicted, support,
        CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE CAST(0 AS DOUBLE) END AS precision,
        CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE CAST(0 AS DOUBLE) END AS recall
        FROM (SELECT class, count(*) FILTER (WHERE label = class AND prediction = class) AS hits,
            count(*) FILTER (WHERE prediction = class) AS predicted, count(*) FILTER (WHERE label = class) AS support
            FROM classes CROSS JOIN predictions GROUP BY class))"""
CTES["metrics"] = """SELECT class, metric, round(value, 4) AS value FROM (
    SELECT class, 'precision' AS metric, precision AS value FROM class_table
    UNION ALL SELECT class, 'recall', recall FROM class_table
    UNION ALL SELECT class, 'f1', f1 FROM class_table
    UNION ALL SELECT class, 'support', CAST(support AS DOUBLE) FROM class_table
    UNION ALL SELECT NULL, 'accuracy', sum(hits) / sum(support) FROM class_table
    UNION ALL SELECT NULL, 'macro_precision', avg(precision) FROM class_table
    UNION ALL SELECT NULL, 'macro_recall', avg(recall) FROM class_table
    UNION ALL SELECT NULL, 'macro_f1', avg(f1) FROM class_table
    UNION ALL SELECT NULL, 'weighted_f1', sum(f1 * support) / sum(support) FROM class_table)"""
WORDS = f"regexp_extract_all(lower(text), {q(WORD)})"
CTES["doc_words"] = f"SELECT doc_id, {WORDS} AS w FROM documents"
CTES["doc_terms"] = "SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS terms FROM doc_words"
CTES["term_counts"] = "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY ALL"
CTES["vocabulary"] = "SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM term_counts GROUP BY term ORDER BY total DESC, term LIMIT 500"
CTES["idfs"] = "SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM vocabulary"

# Which other table expressions a table expression reads.
ORDER = list(CTES)
HEALED_FROM = {"healed": heal_ctes("failures_src"), "checked": flaky_ctes("healed")}


def sql(body: str, **local: str) -> str:
    """Prefix ``body`` with the table expressions it needs, directly or not."""
    pool = {**{n: f"{n} AS ({t})" for n, t in CTES.items()}, **HEALED_FROM,
            **{n: f"{n} AS ({t})" for n, t in local.items()}}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in pool:
            if name not in needed and re.search(rf"(?<![\w'.]){name}(?![\w'.(])", text):
                if name not in visiting:
                    visiting.add(name)
                    visit(pool[name].split(" AS (", 1)[1] if name not in HEALED_FROM else pool[name])
                    needed.append(name)

    visiting: set[str] = set()
    visit(body)
    return ("WITH " + ",\n".join(pool[n] for n in needed) + "\n" if needed else "") + body


def draw(seed: str, key: str) -> str:
    return f"md5(concat('{seed}:', {key}))"


def below(seed: str, key: str, share: float) -> str:
    return f"substr({draw(seed, key)}, 1, 6) < '{format(int(share * 16**6), '06x')}'"


def draw_int(seed: str, key: str) -> str:
    return f"CAST('0x' || substr({draw(seed, key)}, 7, 6) AS BIGINT)"


def label_noise(src: str, seed: str) -> str:
    others = f"list_filter([{listed(vocab.ROOT_CAUSES)}], lambda c: c <> root_cause)"
    return (
        f"SELECT * REPLACE (CASE WHEN {below(seed, 'test_id', 0.10)} THEN "
        f"({others})[{draw_int(seed, 'test_id')} % len({others}) + 1] ELSE root_cause END AS root_cause) FROM {src}"
    )


def generic_noise(src: str) -> str:
    hit = below("generic", "test_id", 0.15)
    return (
        f"SELECT * REPLACE (CASE WHEN {hit} THEN ([{listed(vocab.GENERIC_MESSAGES)}])[{draw_int('generic', 'test_id')} % 5 + 1] "
        f"ELSE error_message END AS error_message, CASE WHEN {hit} THEN {q(vocab.GENERIC_TRACE)} ELSE stack_trace END AS stack_trace) FROM {src}"
    )


def number(col: str, default: float) -> str:
    pattern = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return f"coalesce(CASE WHEN regexp_matches({col}, {q(pattern)}) THEN TRY_CAST(trim({col}) AS DOUBLE) END, {D(default)})"


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


MAPPED = case("coalesce(failure_type, '')", vocab.CATEGORY_CAUSES, q(vocab.CATEGORY_OTHER))
REMAP = {
    "test_id": "run_id",
    "test_name": "concat(coalesce(failure_type, ''), ' — ', repository)",
    "pipeline": "ci_tool", "browser": "'N/A'", "root_cause": MAPPED,
    "failure_type": "coalesce(failure_type, '')", "stack_trace": "''", "old_value": "'N/A'",
    "new_value": "'N/A'", "recommendation": "''", "developer_alert": "incident_created",
}
CTES["remapped"] = "SELECT " + ", ".join(f'{REMAP.get(f, f)} AS "{f}"' for f in TRAINING_FIELDS) + " FROM runs_src"
MISSING = listed(vocab.CSV_MISSING)

JSON_OK = "(json_valid(text) AND " + strip("text") + " <> 'null')"


def jget(*names: str, default: str | None = None) -> str:
    parts = [f"nullif(json_extract_string(j, '$.{n}'), '')" for n in names]
    return f"coalesce({', '.join(parts + ([default] if default else []))})"


JSON_FIELDS = {
    "test_name": jget("test_name", "testName", default="file_name"),
    "error_message": jget("error_message", "errorMessage", "message", default="''"),
    "stack_trace": jget("stack_trace", "stackTrace", default="''"),
    "logs": jget("logs", default="''"),
    "failure_stage": jget("failure_stage", default="'test'"),
    "failure_type": jget("failure_type", default="'Test Failure'"),
    "severity": jget("severity", default="'MEDIUM'"),
    "retry_count": "CASE WHEN nullif(json_extract_string(j, '$.retry_count'), '') IS NULL THEN CAST(0 AS DOUBLE) ELSE TRY_CAST(json_extract_string(j, '$.retry_count') AS DOUBLE) END",
    "pipeline": jget("pipeline", default="'GitHub Actions'"),
    "old_locator": jget("old_locator", "old_value", default="''"),
}
LINES = "string_split(text, chr(10))"
TEXT_FIELDS = {
    "test_name": r"regexp_replace(file_name, '\.(log|json|txt)$', '')",
    "error_message": f"coalesce(nullif(substr({LINES}[1], 1, 500), ''), substr(text, 1, 500))",
    "stack_trace": (
        "CASE WHEN contains(text, 'Exception') OR contains(text, 'Error') THEN coalesce(array_to_string(list_filter("
        + LINES + ", lambda l: regexp_matches(" + strip("l") + r", 'at\s|Exception|Error')), chr(10)), '') ELSE '' END"
    ),
    "logs": "text", "failure_stage": "'test'", "failure_type": "'Test Failure'", "severity": "'MEDIUM'",
    "retry_count": "CAST(0 AS DOUBLE)", "pipeline": "'GitHub Actions'", "old_locator": "''",
}
PARSED = f"SELECT *, CASE WHEN {JSON_OK} THEN 'json' ELSE 'text' END AS format, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM uploads_src"


def cap_rank(src: str, seed: str, label: str = "root_cause", key: str = "test_id") -> str:
    return f"row_number() OVER (PARTITION BY {label} ORDER BY {draw(seed, key)}, {key})"


def split(src: str, label: str = "root_cause", key: str = "test_id") -> str:
    """All rows of a table with their side of the exact split."""
    return (
        f"SELECT *, CASE WHEN rn <= CAST(floor(n * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) THEN 'test' ELSE 'train' END AS side FROM "
        f"(SELECT *, {cap_rank(src, 'split', label, key)} AS rn, count(*) OVER (PARTITION BY {label}) AS n FROM {src})"
    )


def judged(label: str) -> str:
    return f"SELECT {label} AS class, count(*) AS support, true AS in_range, true AS beats_majority FROM sides WHERE side = 'test' GROUP BY 1"


def title(text: str) -> str:
    """Capital at the start of each run of letters."""
    runs = f"regexp_extract_all(lower(replace({text}, '_', ' ')), '[a-z]+|[^a-z]+')"
    return f"array_to_string(list_transform({runs}, lambda p: concat(upper(p[1]), p[2:])), '')"


def page(cols: str, src: str, order: str, number_: int, size: int = 10) -> str:
    return (
        f"SELECT {cols}, (SELECT count(*) FROM {src}) AS total, {number_} AS page, {size} AS page_size "
        f"FROM {src} ORDER BY {order} LIMIT {size} OFFSET {(number_ - 1) * size}"
    )


def trend(as_of: str, fallback: bool) -> str:
    failures = "CASE WHEN (SELECT sum(n) FROM t) = 0 AND (SELECT count(*) FROM failures_src) > 0 THEN greatest(0, (SELECT count(*) FROM failures_src) - position) ELSE n END"
    return f"""WITH failures_src AS ({CTES['failures_src']}),
    spine AS (SELECT i AS position, CAST(CAST('{as_of}' AS TIMESTAMP) AS DATE) - CAST(6 - i AS INTEGER) AS day FROM range(7) r(i)),
    counts AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM failures_src
        WHERE created_at >= CAST('{as_of}' AS TIMESTAMP) - INTERVAL 7 DAY GROUP BY 1),
    t AS (SELECT position, strftime(spine.day, '%a %d') AS name, coalesce(n, 0) AS n FROM spine LEFT JOIN counts USING (day))
    SELECT position, name, CAST({failures if fallback else 'n'} AS BIGINT) AS failures FROM t"""


def knn(src_vec: str = "embedding") -> str:
    return """pairs AS (SELECT a.label, a.vec_id, b.vec_id AS neighbor,
        sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2))) AS distance
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY distance, neighbor) AS rank FROM pairs) WHERE rank <= 5)"""


def oracles(stop_words: list[str]) -> dict[str, str]:
    """Query key -> SQL. ``stop_words`` is the list the Spark side uses."""
    o: dict[str, str] = {}
    stop = f"list_filter(w, lambda t: t NOT IN ({listed(stop_words)}))"
    runs = ", ".join(f'"{c}"' for c, _ in VIEWS["runs_src"][1])

    o["scan_csv_runs"] = sql(f"SELECT {runs} FROM runs_src")
    o["sink_csv_training"] = sql("SELECT * FROM remapped")
    o["scan_csv_training"] = sql(
        "SELECT " + ", ".join(f'CASE WHEN "{f}" NOT IN ({MISSING}) THEN "{f}" END AS "{f}"' for f in TRAINING_FIELDS)
        + " FROM remapped"
    )
    o["ingest_json"] = sql(
        "SELECT id, " + ", ".join(f"{e} AS {c}" for c, e in JSON_FIELDS.items()) + " FROM parsed WHERE json_valid(text)",
        parsed=PARSED,
    )
    o["ingest_text_log"] = sql(
        "SELECT doc_id, " + ", ".join(f"{TEXT_FIELDS[c]} AS {c}" for c in ("test_name", "error_message", "stack_trace"))
        + ", md5(text) AS logs_md5 FROM logs_src"
    )
    o["route_by_format"] = sql(
        "SELECT id, format, "
        + ", ".join(f"CASE WHEN format = 'json' THEN {JSON_FIELDS[c]} ELSE {TEXT_FIELDS[c]} END AS {c}" for c in JSON_FIELDS)
        + " FROM parsed",
        parsed=PARSED,
    )
    o["require_fields"] = sql(
        "SELECT id, CASE WHEN coalesce(test_name, '') = '' THEN 'test_name is required' "
        "WHEN coalesce(error_message, '') = '' THEN 'error_message is required' END AS reject_reason FROM input_src"
    )
    have = {c for c, _ in VIEWS["input_src"][1]}

    def lit(v):
        return q(v) if isinstance(v, str) else (D(v) if isinstance(v, float) else f"CAST({v} AS INTEGER)")

    o["apply_input_defaults"] = sql(
        "SELECT id, test_name, pipeline, error_message, "
        + ", ".join(f"coalesce({c}, {lit(v)}) AS {c}" if c in have else f"{lit(v)} AS {c}" for c, v in vocab.INPUT_DEFAULTS.items())
        + " FROM input_src"
    )
    o["scan_table"] = sql("SELECT id, test_id, test_name, root_cause, confidence, healing, developer_alert FROM failures")
    o["append_rows"] = sql(
        "SELECT id, test_id, test_name, root_cause FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY id) AS rn FROM incoming "
        "WHERE test_name IS NOT NULL) WHERE rn = 1 AND test_id NOT IN (SELECT test_id FROM failures_src WHERE outcome = 'PASS')",
        incoming="SELECT id, test_id, nullif(test_name, 'Test 3') AS test_name, root_cause FROM failures UNION ALL "
        "SELECT id + 1000000000, test_id, test_name, root_cause FROM failures",
    )
    totals = "SELECT " + ", ".join(
        f"(SELECT count(*) FROM {t}) AS total_{t}" for t in ("failures", "healing_actions", "flaky_tests", "notifications")
    )
    o["summary_counts"] = sql(totals)
    o["persist_fanout"] = o["stream_triage"] = sql(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, id, md5(concat_ws('|', {', '.join(cols)})) AS row_md5 FROM {t}" for t, cols in {
            "failures": ["test_id", "test_name", "pipeline", "status", "root_cause", "confidence", "healing", "logs", "stack_trace", "recommendation"],
            "healing_actions": ["healing_id", "failure_test_id", "test_name", "repair_type", "old_value", "new_value", "status"],
            "flaky_tests": ["test_code", "test_name", "instability_score", "risk_level"],
            "notifications": ["failure_test_id", "test_name", "root_cause", "message", "target"],
        }.items()
    ))
    o["stream_scored"] = sql("SELECT test_id, true AS known_cause FROM failures_src")
    o["failures_of_days"] = sql(
        "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS failures FROM failures_src "
        "WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' GROUP BY 1"
    )
    third = "(SELECT test_id FROM known_keys WHERE CAST(substr(test_id, 6) AS BIGINT) % 3 = 0)"
    o["changed_store"] = sql(
        "SELECT 'failures' AS table_name, id, CASE WHEN test_id IN (SELECT test_id FROM known_keys) THEN 'HEALED' ELSE status END AS status "
        f"FROM failures WHERE test_id NOT IN {third} UNION ALL SELECT 'healing_actions', id, CASE WHEN failure_test_id IN "
        f"(SELECT test_id FROM known_keys) THEN 'Applied' ELSE status END FROM healing_actions WHERE failure_test_id NOT IN {third} "
        f"UNION ALL SELECT 'flaky_tests', id, NULL FROM flaky_tests WHERE test_code NOT IN {third} "
        f"UNION ALL SELECT 'notifications', id, NULL FROM notifications WHERE failure_test_id NOT IN {third}"
    )

    o["counted_store"] = sql(
        "SELECT 'summary' AS report, 'total_failures' AS name, (SELECT count(*) FROM left_f) AS value UNION ALL "
        f"SELECT 'summary', 'total_healing_actions', (SELECT count(*) FROM healing_actions WHERE failure_test_id NOT IN {third}) UNION ALL "
        "SELECT 'summary', 'total_flaky_tests', (SELECT count(*) FROM left_t) UNION ALL "
        f"SELECT 'summary', 'total_notifications', (SELECT count(*) FROM notifications WHERE failure_test_id NOT IN {third}) UNION ALL "
        f"SELECT 'cause', {title('root_cause')}, count(*) FROM left_f GROUP BY root_cause UNION ALL "
        "SELECT 'risk', name, (SELECT count(*) FROM left_t WHERE lower(risk_level) = lower(name)) FROM (SELECT unnest(['High', 'Medium', 'Low']) AS name) UNION ALL "
        "SELECT 'trend', strftime(day, '%a %d'), (SELECT count(*) FROM left_f WHERE CAST(created_at AS DATE) = day) "
        f"FROM (SELECT CAST(TIMESTAMP '{AS_OF}' - to_days(CAST(i AS INTEGER)) AS DATE) AS day FROM range(7) t(i))",
        left_f=f"SELECT * FROM failures WHERE test_id NOT IN {third}", left_t=f"SELECT * FROM flaky_tests WHERE test_code NOT IN {third}",
    )

    o["drop_null_target"] = sql("SELECT id, root_cause FROM dirty_src WHERE root_cause IS NOT NULL")
    o["normalize_label"] = sql(f"SELECT id, lower({strip('root_cause')}) AS root_cause FROM dirty_src")
    o["valid_class_filter"] = sql(
        f"SELECT * FROM (SELECT id, lower({strip('root_cause')}) AS root_cause FROM dirty_src) WHERE root_cause IN ({listed(vocab.ROOT_CAUSES)})"
    )
    fills = ", ".join(f"coalesce({c}, {q(v)}) AS {c}" for c, v in vocab.TEXT_FILLS.items())
    numbers = ", ".join(f"{number(c, v)} AS {c}" for c, v in vocab.NUMBER_FILLS.items())
    flag = "CAST(CASE WHEN is_flaky_test = 'True' THEN 1 ELSE 0 END AS INTEGER)"
    o["null_fill_text"] = sql(f"SELECT id, {fills} FROM dirty_src")
    o["numeric_coerce"] = sql(f"SELECT id, {numbers} FROM dirty_src")
    o["numeric_coerce_zero"] = sql(
        "SELECT id, " + ", ".join(f"{number(c, 0)} AS {c}" for c in vocab.NUMBER_FILLS) + " FROM dirty_src"
    )
    o["bool_coerce"] = sql(
        f"SELECT id, {flag} AS is_flaky_test, CAST(CASE WHEN is_flaky_test IN ('True', '1') THEN 1 ELSE 0 END AS INTEGER) AS with_digits FROM dirty_src"
    )
    o["project_dropna"] = sql(
        "SELECT id, error_message, failure_type FROM dirty_src WHERE error_message IS NOT NULL AND failure_type IS NOT NULL"
    )
    o["clean_training"] = sql(
        f"SELECT * FROM (SELECT id, lower({strip('root_cause')}) AS root_cause, {fills}, {numbers}, {flag} AS is_flaky_test FROM dirty_src) "
        f"WHERE root_cause IN ({listed(vocab.ROOT_CAUSES)})"
    )
    o["category_map"] = sql(f"SELECT run_id, {MAPPED} AS root_cause FROM runs_src")
    o["remap_runs_schema"] = sql("SELECT * FROM remapped")
    o["generic_message_noise"] = sql("SELECT test_id, error_message, stack_trace FROM noisy", noisy=generic_noise("failures_src"))
    o["label_noise"] = sql("SELECT test_id, root_cause FROM noisy", noisy=label_noise("failures_src", "label"))
    merged_cols = "test_id, test_name, root_cause, failure_type, error_message, severity"
    o["merge_datasets"] = sql(
        f"SELECT {merged_cols} FROM noisy3",
        noisy1=generic_noise("failures_src"), noisy2=label_noise("noisy1", "synthetic"),
        merged=f"SELECT {merged_cols} FROM remapped UNION ALL SELECT {merged_cols} FROM noisy2",
        noisy3=label_noise("merged", "merged"),
    )
    mixed = "concat('db-', root_cause, '_3x''s')"
    o["title_case_cause"] = sql(f"SELECT id, {title('root_cause')} AS title, {title(mixed)} AS mixed FROM failures_src")

    o["extract_locator"] = sql(f"SELECT id, {LOCATOR} AS locator FROM failures_src")
    o["normalize_locator"] = sql(f"SELECT id, {selector(LOCATOR)} AS selector FROM failures_src")
    o["extract_wait_call"] = sql(f"SELECT id, {WAIT} AS wait_call FROM failures_src")
    o["upgrade_wait"] = sql(f"SELECT id, {new_wait('(' + WAIT + ')')} AS new_wait FROM failures_src")
    o["fallback_old_value"] = sql(
        f"SELECT id, coalesce(nullif(old_locator, ''), {OLD_DEFAULT}) AS old_value FROM (SELECT *, {RC} AS rc FROM failures_src)"
    )
    o["repair_playbook"] = sql(
        "SELECT id, " + ", ".join(f"{field(f)} AS {f}" for f in ("repair_type", "status", "developer_alert", "recommendation"))
        + f" FROM (SELECT *, {RC} AS rc FROM failures_src)"
    )
    o["heal"] = sql(f"SELECT test_id, {HEAL_FIELDS} FROM healed")
    o["heal_fallback"] = (
        f"WITH gaps_src AS ({CTES['gaps_src']}),{heal_ctes('gaps_src')} SELECT test_id, {HEAL_FIELDS} FROM healed"
    )
    o["make_ids"] = sql(
        f"SELECT test_id, {make_id('H', 'test_id')} AS healing_id, {make_id('N', 'test_id', 8)} AS notification_id FROM failures_src"
    )

    o["instability_score"] = sql("SELECT id, score FROM scored")
    o["risk_level"] = sql(f"SELECT id, {RISK} AS risk_level FROM scored")
    o["flaky_flag"] = sql("SELECT id, score >= CAST(0.4 AS DOUBLE) AS is_flaky FROM scored")
    o["score_percent_text"] = sql(f"SELECT id, {CUT_PERCENT} AS score_text FROM scored")
    flaky_cols = "is_flaky, flaky_probability, risk_level, instability_score"
    o["check_flaky"] = sql(f"SELECT test_id, test_name, {flaky_cols} FROM checked")
    o["flaky_fallback"] = (
        f"WITH gaps_src AS ({CTES['gaps_src']}),{flaky_ctes('gaps_src')} SELECT test_id, {flaky_cols} FROM checked"
    )
    pattern = (
        "SELECT test_name, string_agg(outcome, ', ' ORDER BY created_at, id) AS recent_pattern FROM (SELECT *, row_number() OVER "
        "(PARTITION BY test_name ORDER BY created_at DESC, id DESC) AS rn FROM failures_src) WHERE rn <= 5 GROUP BY test_name"
    )
    o["recent_pattern"] = o["stream_recent_pattern"] = sql(pattern)
    o["flip_rate"] = sql(
        "SELECT test_name, count(*) AS runs, count(*) FILTER (WHERE before <> outcome) AS flips, "
        "round(CASE WHEN count(*) > 1 THEN CAST(count(*) FILTER (WHERE before <> outcome) AS DOUBLE) / (count(*) - 1) ELSE 0 END, 6) AS flip_rate "
        "FROM (SELECT *, lag(outcome) OVER (PARTITION BY test_name ORDER BY created_at, id) AS before FROM failures_src) GROUP BY test_name"
    )
    o["explode_pattern"] = sql(
        "SELECT test_name, CAST(i AS INTEGER) AS position, string_split(recent_pattern, ', ')[i + 1] AS outcome FROM patterns, range(5) r(i) "
        "WHERE i < len(string_split(recent_pattern, ', '))",
        patterns=pattern,
    )

    o["alert_filter"] = sql("SELECT test_id, root_cause FROM healed WHERE developer_alert")
    o["alert_message"] = sql(f"SELECT test_id, {MESSAGE} AS message FROM healed")
    routed = (
        f"SELECT test_id, CASE WHEN req IN ({listed(vocab.TARGET_LABELS)}) THEN req ELSE {BY_CAUSE} END AS target FROM "
        "(SELECT *, CASE severity WHEN 'HIGH' THEN 'manager' WHEN 'LOW' THEN 'ops' END AS req FROM failures_src)"
    )
    o["route_target"] = sql(routed)
    o["target_label"] = sql(
        f"SELECT test_id, {case('target', vocab.TARGET_LABELS, q('Developer'))} AS label FROM routed", routed=routed
    )
    o["notifications_by_target"] = sql(
        f"SELECT {BY_CAUSE} AS target, root_cause, count(*) AS alerts FROM healed WHERE developer_alert GROUP BY 1, 2"
    )
    o["triage"] = sql(
        f"SELECT test_id, root_cause, confidence, {HEAL_FIELDS}, {flaky_cols}, "
        f"CASE WHEN developer_alert THEN {make_id('N', 'test_id')} END AS notification_id, "
        f"CASE WHEN developer_alert THEN {MESSAGE} END AS message, CASE WHEN developer_alert THEN 'developer' END AS target FROM checked"
    )

    o["lookup_failure"] = sql("SELECT id, test_id, root_cause, status FROM failures WHERE test_id IN (SELECT test_id FROM key_list)")
    o["lookup_stored"] = o["lookup_failure"]
    o["incident_view"] = sql(
        "SELECT f.test_id, f.root_cause, f.confidence, h.repair_type, h.new_value, k.risk_level, n.message FROM failures f "
        "LEFT JOIN healing_actions h ON h.failure_test_id = f.test_id LEFT JOIN flaky_tests k ON k.test_code = f.test_id "
        "LEFT JOIN notifications n ON n.failure_test_id = f.test_id"
    )
    o["apply_heal"] = sql(
        "SELECT 'failures' AS table_name, id, CASE WHEN test_id IN (SELECT test_id FROM known_keys) THEN 'HEALED' ELSE status END AS status, "
        "CASE WHEN test_id IN (SELECT test_id FROM known_keys) THEN 'Applied' ELSE healing END AS healing FROM failures UNION ALL "
        "SELECT 'healing_actions', id, CASE WHEN id IN (SELECT min(id) FROM healing_actions WHERE failure_test_id IN "
        "(SELECT test_id FROM known_keys) GROUP BY failure_test_id) THEN 'Applied' ELSE status END, NULL FROM healing_actions"
    )
    o["delete_cascade"] = sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, {k} AS test_id FROM {t} WHERE {k} NOT IN (SELECT test_id FROM known_keys)"
            for t, k in (("failures", "test_id"), ("healing_actions", "failure_test_id"), ("flaky_tests", "test_code"), ("notifications", "failure_test_id"))
        )
    )
    o["delete_one"] = sql(
        f"SELECT 'healing_actions' AS table_name, id FROM healing_actions WHERE healing_id NOT IN (SELECT {make_id('H', 'test_id')} FROM key_list) "
        "UNION ALL SELECT 'flaky_tests', id FROM flaky_tests WHERE test_code NOT IN (SELECT test_id FROM key_list) "
        "UNION ALL SELECT 'notifications', id FROM notifications WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
    )
    o["missing_keys"] = sql("SELECT DISTINCT test_id FROM key_list WHERE test_id NOT IN (SELECT test_id FROM failures)")
    o["add_created_at"] = sql(
        f"SELECT id, CASE WHEN healing = 'Pending' THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') ELSE '{AS_OF}' END AS created_at FROM failures"
    )

    o["failure_trend"] = trend(AS_OF, False)
    o["failure_trend_fallback"] = trend("2034-01-30 23:59:59", True)
    o["root_cause_breakdown"] = sql(
        f"SELECT {title('root_cause')} AS name, count(*) AS value, "
        + case("root_cause", vocab.CAUSE_COLORS, q(vocab.OTHER_COLOR)) + " AS color FROM failures GROUP BY root_cause"
    )
    levels = "SELECT unnest(['High', 'Medium', 'Low']) AS name"
    o["risk_distribution"] = sql(
        "SELECT name, (SELECT count(*) FROM flaky_tests WHERE lower(risk_level) = lower(name)) AS value FROM levels", levels=levels
    )
    o["risk_share"] = sql(
        "SELECT name, value, CAST(CASE WHEN total > 0 THEN floor(value * CAST(100 AS DOUBLE) / total + 0.5) ELSE 0 END AS BIGINT) AS percent FROM "
        "(SELECT name, (SELECT count(*) FROM flaky_tests WHERE lower(risk_level) = lower(name)) AS value, "
        "(SELECT count(*) FROM flaky_tests) AS total FROM levels)",
        levels=levels,
    )
    mean = "CAST(floor(avg(CAST(replace(instability_score, '%', '') AS INTEGER)) + 0.5) AS BIGINT) AS average_score"
    o["avg_instability"] = sql(
        f"SELECT 'page' AS scope, {mean} FROM (SELECT * FROM flaky_tests ORDER BY id DESC LIMIT 10) UNION ALL SELECT 'all', {mean} FROM flaky_tests"
    )
    o["high_risk_count"] = sql("SELECT count(*) AS high_risk FROM flaky_tests WHERE risk_level = 'High'")
    o["class_distribution"] = sql(
        "SELECT failure_type AS label, count(*) AS count, round(count(*) * CAST(100 AS DOUBLE) / (SELECT count(failure_type) FROM runs_src), 1) AS percent "
        "FROM runs_src WHERE failure_type IS NOT NULL GROUP BY failure_type"
    )
    o["missing_profile"] = sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM dirty_src" for c, _ in VIEWS["dirty_src"][1]
        )
    )
    names = ", ".join(c for c, _ in VIEWS["runs_src"][1])
    o["shape_profile"] = sql(
        f"SELECT count(*) AS n_rows, CAST({len(VIEWS['runs_src'][1])} AS BIGINT) AS n_columns, {q(names)} AS column_names FROM runs_src"
    )
    o["sample_messages"] = sql("SELECT run_id, failure_type, error_message FROM runs_src ORDER BY run_id LIMIT 10")
    o["recent_failures"] = sql(
        "SELECT id, test_id, test_name, pipeline, status, root_cause, healing FROM failures ORDER BY id DESC LIMIT 5"
    )
    o["page_stored"] = sql(
        f"SELECT * FROM ({page("'failures' AS table_name, id", 'failures', 'created_at DESC, id DESC', 70)}) UNION ALL "
        f"SELECT * FROM ({page("'notifications' AS table_name, id", 'notifications', 'id DESC', 20)})"
    )
    o["page_failures"] = sql(page("id, test_id, root_cause", "failures", "created_at DESC, id DESC", 3))
    o["page_healing"] = sql(page("id, healing_id, status", "healing_actions", "id DESC", 2))
    o["page_flaky"] = sql(page("id, test_code, risk_level", "flaky_tests", "id DESC", 2))
    o["page_notifications"] = sql(page("id, failure_test_id, target", "notifications", "id DESC", 2))
    o["page_after"] = sql("SELECT id, failure_test_id, target FROM notifications WHERE id < 900 ORDER BY id DESC LIMIT 10")
    o["total_pages"] = sql("SELECT count(*) AS total, CAST(ceil(count(*) / CAST(10 AS DOUBLE)) AS BIGINT) AS total_pages FROM failures")
    share = "round(CAST(CAST('0x' || substr(md5(concat(class, id)), 1, 4) AS BIGINT) AS DOUBLE) / CAST(65536 AS DOUBLE), 4)"
    o["rank_probabilities"] = sql(
        "SELECT id, row_number() OVER (PARTITION BY id ORDER BY probability DESC, root_cause) AS rank, root_cause, probability FROM "
        f"(SELECT id, class AS root_cause, {share} AS probability FROM failures_src CROSS JOIN classes)"
    )

    o["cap_per_class"] = sql(
        f"SELECT test_id, root_cause FROM (SELECT *, {cap_rank('failures_src', 'cap')} AS rn FROM failures_src) WHERE rn <= 2000"
    )
    o["seeded_shuffle"] = sql(f"SELECT test_id, {draw('shuffle', 'test_id')} AS sort_key FROM failures_src")
    o["stratified_split"] = sql("SELECT test_id, root_cause, side FROM sides", sides=split("failures_src"))
    o["threshold_split"] = sql(
        f"SELECT test_id, CASE WHEN {below('split', 'test_id', 0.2)} THEN 'test' ELSE 'train' END AS side FROM failures_src"
    )
    o["class_weights"] = sql(
        "SELECT root_cause, count(*) AS count, round(CAST((SELECT count(*) FROM failures_src) AS DOUBLE) / "
        "((SELECT count(DISTINCT root_cause) FROM failures_src) * count(*)), 6) AS weight FROM failures_src GROUP BY root_cause"
    )

    o["tokenize_terms"] = sql(
        "SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, md5(coalesce(array_to_string(terms, '|'), '')) AS terms_md5 FROM doc_terms"
    )
    o["vocabulary_topk"] = sql("SELECT term, total, df FROM vocabulary")
    o["idf_table"] = sql("SELECT term, df, round(idf, 6) AS idf FROM idfs")
    weights = "SELECT doc_id, term, {tf} * idf AS w FROM {counts} JOIN {idf} USING (term)"
    o["tfidf"] = sql(
        "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted",
        weighted=weights.format(tf="(1.0::DOUBLE + ln(tf))", counts="term_counts", idf="idfs"),
    )
    o["tfidf_baseline"] = sql(
        "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted",
        word_counts=f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({stop}) AS term FROM doc_words) GROUP BY ALL",
        top_words="SELECT term, sum(tf) AS total, count(*) AS df FROM word_counts GROUP BY term ORDER BY total DESC, term LIMIT 5000",
        word_idf="SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM top_words",
        weighted=weights.format(tf="CAST(tf AS DOUBLE)", counts="word_counts", idf="word_idf"),
    )
    o["remove_stop_words"] = sql(
        f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n_kept, md5(coalesce(array_to_string(k, '|'), '')) AS kept_md5 FROM (SELECT doc_id, {stop} AS k FROM doc_words)"
    )
    codes = {
        c: f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM failures_src WHERE outcome = 'FAIL'))"
        for c in ("failure_stage", "severity", "failure_type")
    }
    o["ordinal_encode"] = sql(
        "SELECT id, " + ", ".join(f"coalesce({c}_t.code, -1) AS {c}_code" for c in codes) + " FROM failures_src "
        + " ".join(f"LEFT JOIN {t} {c}_t ON {c}_t.v = {c}" for c, t in codes.items())
    )
    o["label_encode"] = sql(
        "SELECT id, code AS root_cause_code, root_cause AS decoded FROM failures_src JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code "
        "FROM (SELECT DISTINCT root_cause AS v FROM failures_src)) ON v = root_cause"
    )
    o["smote_knn"] = f"WITH {knn()} SELECT label, vec_id, rank, neighbor, round(distance, 5) AS distance FROM near"
    pick = "concat(CAST(base AS VARCHAR), ':', CAST(copy AS VARCHAR))"
    o["smote"] = f"""WITH {knn()},
    sizes AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
    plan AS (SELECT label, size, hi - size AS needed, least(5, lo - 1) AS k
        FROM sizes, (SELECT min(size) AS lo, max(size) AS hi FROM sizes) WHERE lo < 500 AND lo > 1 AND hi > size),
    bases AS (SELECT label, vec_id AS base, embedding, needed, size, k, row_number() OVER (PARTITION BY label ORDER BY {draw('smote', 'vec_id')}, vec_id) AS rn
        FROM embeddings JOIN plan USING (label)),
    counted AS (SELECT *, needed // size + CASE WHEN rn <= needed % size THEN 1 ELSE 0 END AS copies FROM bases),
    each_ AS (SELECT label, base, embedding, k, unnest(range(copies)) AS copy FROM counted),
    drawn AS (SELECT *, {draw_int('smote-neighbor', pick)} % k + 1 AS rank, {draw_int('smote-step', pick)} / CAST(16777216 AS DOUBLE) AS u FROM each_),
    made AS (SELECT d.label, d.base, d.copy, n.neighbor, list_transform(range(1, len(d.embedding) + 1),
        lambda i: CAST(d.embedding[i] AS DOUBLE) + d.u * (CAST(e.embedding[i] AS DOUBLE) - CAST(d.embedding[i] AS DOUBLE))) AS v
        FROM drawn d JOIN near n ON n.label = d.label AND n.vec_id = d.base AND n.rank = d.rank JOIN embeddings e ON e.vec_id = n.neighbor)
    SELECT label, base, copy, neighbor, round(v[1], 5) AS first_value, round(list_sum(v), 4) AS total FROM made"""

    tested = sql(judged("root_cause"), sides=split("failures_src"))
    o["train_random_forest"] = o["train_gradient_boosting"] = o["vote_ensemble"] = tested
    known = "SELECT * FROM runs_src WHERE failure_type IS NOT NULL"
    o["train_text_baseline"] = o["train_structured_baseline"] = sql(
        judged("failure_type"), known=known, sides=split("known", "failure_type", "run_id")
    )
    o["tune_grid"] = "SELECT * FROM (VALUES (10, 50, true), (10, 100, true), (20, 50, true), (20, 100, true)) t(max_depth, num_trees, accuracy_in_range)"
    o["score_failures"] = o["score_gaps"] = sql(
        "SELECT test_id, true AS known_cause, true AS confidence_is_largest, true AS cause_is_likeliest, true AS sums_to_one, "
        "'RandomForest' AS model_used FROM failures_src"
    )
    o["triage_scored"] = sql(
        "SELECT test_id, 'RandomForest' AS model_used, true AS same_cause, true AS has_repair, instability_score, true AS alert_sent FROM checked"
    )
    o["assemble_features"] = sql(
        "SELECT test_id, round(retry_count, 4) AS retry_count, round(test_duration_sec, 4) AS test_duration_sec, round(cpu_usage_pct, 4) AS cpu_usage_pct, "
        "round(memory_usage_mb, 4) AS memory_usage_mb, round(CAST(is_flaky_test AS DOUBLE), 4) AS is_flaky_test, true AS unit_texts FROM failures_src"
    )
    routed = "SELECT file_name, text, " + ", ".join(
        f"CASE WHEN format = 'json' THEN {JSON_FIELDS[c]} ELSE {TEXT_FIELDS[c]} END AS {c}" for c in JSON_FIELDS if c != "retry_count"
    ) + f", CASE WHEN format = 'json' THEN coalesce({JSON_FIELDS['retry_count']}, {D(0)}) ELSE {D(0)} END AS retry_count, {D(30)} AS test_duration_sec FROM parsed"
    o["analyze_uploads"] = sql(
        f"SELECT test_id, test_name, error_message, failure_stage, severity, true AS known_cause, {make_id('H', 'test_id')} AS healing_id, "
        f"{RISK} AS risk_level FROM (SELECT *, {SCORE} AS score, {make_id('TEST', 'concat(file_name, chr(10), text)')} AS test_id FROM routed "
        "WHERE coalesce(test_name, '') <> '' AND coalesce(error_message, '') <> '')",
        parsed=PARSED, routed=routed,
    )
    o["save_model"] = sql("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differ FROM sides WHERE side = 'test'", sides=split("failures_src"))
    o["confidence_text"] = sql(f"SELECT id, {PERCENT} AS confidence FROM failures_src")
    o["metrics_json"] = sql("SELECT 'rule' AS model, class, metric, value FROM metrics")

    o["confusion_matrix"] = sql(
        "SELECT a.class AS label, b.class AS prediction, (SELECT count(*) FROM predictions p WHERE p.label = a.class AND p.prediction = b.class) AS count "
        "FROM classes a CROSS JOIN classes b"
    )
    hit = "round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy"
    o["accuracy"] = sql(f"SELECT {hit} FROM predictions")
    o["per_class_metrics"] = sql(
        "SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM class_table"
    )
    o["macro_metrics"] = sql(
        "SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM class_table"
    )
    o["weighted_f1"] = sql("SELECT round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM class_table")
    compared = f"SELECT 'RandomForest' AS model, {hit} FROM second UNION ALL SELECT 'GradientBoosting', {hit} FROM predictions"
    o["model_comparison"] = sql(compared)
    o["select_best"] = sql(
        "SELECT model AS model_name, accuracy FROM compared ORDER BY accuracy DESC, CASE model WHEN 'RandomForest' THEN 0 ELSE 1 END LIMIT 1",
        compared=compared,
    )
    o["metric_band"] = sql(
        "SELECT class, metric, value, CASE WHEN value * 100 >= 80 THEN 'good' WHEN value * 100 >= 60 THEN 'fair' ELSE 'poor' END AS band "
        "FROM metrics WHERE metric <> 'support'"
    )

    o["stream_dedupe"] = sql("SELECT test_id, root_cause, outcome FROM failures_src")
    o["stream_trend"] = sql(
        "SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, count(*) AS failures FROM failures_src GROUP BY 1 "
        "HAVING CAST(max(CAST(created_at AS DATE)) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(created_at) FROM failures_src) - INTERVAL 1 HOUR"
    )
    return o
