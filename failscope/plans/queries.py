"""One query per operator over the given tables.

Each query takes (spark, folder) and returns a flat DataFrame whose columns are named as
in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flaky as flaky_f
from ..functions import repair, vocab
from ..functions.columns import draw, make_id, percent_text, percent_text_cut, title_case
from ..operators import (
    alerts, clean, evaluate, features, flaky, models, oversample, reports, sampling, tables,
)
from ..operators.heal import heal
from ..operators.parallel import spread
from ..operators.training import TrainingSet, bounded, report
from ..operators.triage import analyze, triage
from ..session import configure
from ..sources import readers, schemas, store
from ..streaming import jobs
from .views import AS_OF, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


# --- shared inputs ----------------------------------------------------------------------

def failures_src(spark, d):
    return view(spark, d, "failures_src")


def analyzed(spark, d):
    return triage(failures_src(spark, d))


def stored(spark, d) -> dict[str, DataFrame]:
    return store.table_rows(analyzed(spark, d))


def healed(spark, d):
    return heal(failures_src(spark, d))


def key_list(spark, d):
    """Keys to change: the orders with status F name them; many name no failure."""
    padded = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.concat(F.lit("TEST-"), padded).alias("test_id")
    )


def predictions(spark, d):
    """Given cause as label; the cause by id alone as prediction."""
    names = F.array(*[F.lit(c) for c in vocab.ROOT_CAUSES])
    return failures_src(spark, d).select(
        F.col("root_cause").alias("label"),
        F.get(names, (F.col("id") % 6).cast("int")).alias("prediction"),
    )


def second_predictions(spark, d):
    """A weaker rule: everything with a given locator is a locator issue."""
    return predictions_by(spark, d, F.when(F.col("old_locator") == "#pay-now", "locator_issue"))


def predictions_by(spark, d, override):
    names = F.array(*[F.lit(c) for c in vocab.ROOT_CAUSES])
    by_id = F.get(names, (F.col("id") % 6).cast("int"))
    return failures_src(spark, d).select(
        F.col("root_cause").alias("label"), F.coalesce(override, by_id).alias("prediction")
    )


# --- sources and sinks ------------------------------------------------------------------

@query
def scan_csv_runs(spark, d):
    path = store.scratch_dir(spark, "runs")
    rows = view(spark, d, "runs_src")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return readers.scan_csv_runs(spark, path)


@query
def sink_csv_training(spark, d):
    path = store.scratch_dir(spark, "training")
    readers.sink_csv_training(clean.remap_runs_schema(view(spark, d, "runs_src")), path)
    cells = readers.scan_csv_training(spark, path, missing=False)
    # An empty cell and a missing one look alike in CSV.
    return cells.select(*[F.coalesce(c, F.lit("")).alias(c) for c in cells.columns])


@query
def scan_csv_training(spark, d):
    path = store.scratch_dir(spark, "training")
    readers.sink_csv_training(clean.remap_runs_schema(view(spark, d, "runs_src")), path)
    return readers.scan_csv_training(spark, path)


UPLOAD_COLUMNS = [
    "test_name", "error_message", "stack_trace", "logs", "failure_stage", "failure_type",
    "severity", "retry_count", "pipeline", "old_locator",
]


@query
def ingest_json(spark, d):
    uploads = view(spark, d, "uploads_src").filter(F.try_parse_json("text").isNotNull())
    return readers.ingest_json(uploads).select("id", *UPLOAD_COLUMNS)


@query
def ingest_text_log(spark, d):
    logs = readers.ingest_text_log(view(spark, d, "logs_src"))
    return logs.select("doc_id", "test_name", "error_message", "stack_trace", F.md5("logs").alias("logs_md5"))


@query
def route_by_format(spark, d):
    return readers.route_by_format(view(spark, d, "uploads_src")).select("id", "format", *UPLOAD_COLUMNS)


@query
def require_fields(spark, d):
    return clean.require_fields(view(spark, d, "input_src")).select("id", "reject_reason")


@query
def apply_input_defaults(spark, d):
    return clean.apply_input_defaults(view(spark, d, "input_src"))


def _saved(spark, d) -> str:
    root = store.scratch_dir(spark, "store")
    store.persist_fanout(analyzed(spark, d), root, "first")
    return root


@query
def scan_table(spark, d):
    return store.scan_table(spark, _saved(spark, d), "failures").select(
        "id", "test_id", "test_name", "root_cause", "confidence", "healing", "developer_alert"
    )


@query
def append_rows(spark, d):
    source = analyzed(spark, d)
    existing = store.table_rows(source.filter("outcome = 'PASS'"))["failures"]
    rows = stored(spark, d)["failures"]
    copies = rows.withColumn("id", F.col("id") + 1_000_000_000)
    incoming = rows.withColumn("test_name", F.nullif("test_name", F.lit("Test 3"))).unionByName(copies)
    return tables.append_rows(existing, incoming, "failures").select("id", "test_id", "test_name", "root_cause")


@query
def persist_fanout(spark, d):
    root = _saved(spark, d)
    return content(spark, root)


STORED_TEXTS = {
    "failures": ["test_id", "test_name", "pipeline", "status", "root_cause", "confidence", "healing", "logs", "stack_trace", "recommendation"],
    "healing_actions": ["healing_id", "failure_test_id", "test_name", "repair_type", "old_value", "new_value", "status"],
    "flaky_tests": ["test_code", "test_name", "instability_score", "risk_level"],
    "notifications": ["failure_test_id", "test_name", "root_cause", "message", "target"],
}


def content(spark, root) -> DataFrame:
    """A digest of every stored row."""
    parts = [
        store.scan_table(spark, root, name).select(F.lit(name).alias("table_name"), "id", F.md5(F.concat_ws("|", *cols)).alias("row_md5"))
        for name, cols in STORED_TEXTS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def failures_of_days(spark, d):
    """Failures of ten days from a store, which reads these days' folders only."""
    rows = store.failures_of_days(spark, _saved(spark, d), "2024-01-11", "2024-01-20")
    return rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("failures"))


def _every_third(keys):
    return keys.filter(F.substring("test_id", 6, 8).cast("bigint") % 3 == 0)


@query
def changed_store(spark, d):
    """Save, heal, delete every third, compact, and read what is left."""
    root, keys = _saved(spark, d), key_list(spark, d)
    tables.store_heal(spark, root, keys, "healed")
    tables.store_delete(spark, root, _every_third(keys), "deleted")
    store.compact(spark, root)
    left = [
        store.scan_table(spark, root, name).select(
            F.lit(name).alias("table_name"), "id", F.col("status") if name in ("failures", "healing_actions") else F.lit(None).cast("string").alias("status")
        )
        for name in schemas.TABLES
    ]
    return reduce(DataFrame.unionByName, left)


# --- cleaning ---------------------------------------------------------------------------

def dirty(spark, d):
    return view(spark, d, "dirty_src")


@query
def drop_null_target(spark, d):
    return clean.drop_null_target(dirty(spark, d)).select("id", "root_cause")


@query
def normalize_label(spark, d):
    return clean.normalize_label(dirty(spark, d)).select("id", "root_cause")


@query
def valid_class_filter(spark, d):
    return clean.valid_class_filter(clean.normalize_label(dirty(spark, d))).select("id", "root_cause")


@query
def null_fill_text(spark, d):
    return clean.null_fill_text(dirty(spark, d)).select("id", *vocab.TEXT_FILLS)


@query
def numeric_coerce(spark, d):
    return clean.numeric_coerce(dirty(spark, d)).select("id", *vocab.NUMBER_FILLS)


@query
def numeric_coerce_zero(spark, d):
    zeros = {c: 0.0 for c in vocab.NUMBER_FILLS}
    return clean.numeric_coerce(dirty(spark, d), zeros).select("id", *zeros)


@query
def bool_coerce(spark, d):
    rows = dirty(spark, d).withColumn("with_digits", F.col("is_flaky_test"))
    return clean.bool_coerce(clean.bool_coerce(rows), "with_digits", digits=True).select(
        "id", "is_flaky_test", "with_digits"
    )


@query
def project_dropna(spark, d):
    return clean.project_dropna(dirty(spark, d), ["id", "error_message", "failure_type"])


@query
def clean_training(spark, d):
    return clean.clean_training(dirty(spark, d))


@query
def category_map(spark, d):
    return view(spark, d, "runs_src").select("run_id", clean.category_map("failure_type").alias("root_cause"))


@query
def remap_runs_schema(spark, d):
    return clean.remap_runs_schema(view(spark, d, "runs_src"))


@query
def generic_message_noise(spark, d):
    return clean.generic_message_noise(failures_src(spark, d)).select("test_id", "error_message", "stack_trace")


@query
def label_noise(spark, d):
    return clean.label_noise(failures_src(spark, d)).select("test_id", "root_cause")


def synthetic_training(spark, d):
    """The failures in the shape of the training set."""
    rows = failures_src(spark, d).withColumns(
        {
            "old_value": F.col("old_locator"),
            "timestamp": F.date_format("created_at", "yyyy-MM-dd"),
        }
    )
    have = set(rows.columns)
    return rows.select(
        *[(F.col(c).cast("string") if c in have else F.lit("")).alias(c) for c in vocab.TRAINING_FIELDS]
    )


@query
def merge_datasets(spark, d):
    noisy = clean.label_noise(clean.generic_message_noise(synthetic_training(spark, d)), seed="synthetic")
    merged = clean.merge_datasets(clean.remap_runs_schema(view(spark, d, "runs_src")), noisy)
    return clean.label_noise(merged, seed="merged").select(
        "test_id", "test_name", "root_cause", "failure_type", "error_message", "severity"
    )


@query
def title_case_cause(spark, d):
    mixed = F.concat(F.lit("db-"), F.col("root_cause"), F.lit("_3x's"))
    return failures_src(spark, d).select("id", title_case("root_cause").alias("title"), title_case(mixed).alias("mixed"))


# --- repair -----------------------------------------------------------------------------

@query
def extract_locator(spark, d):
    return failures_src(spark, d).select(
        "id", repair.extract_locator("error_message", "old_locator").alias("locator")
    )


@query
def normalize_locator(spark, d):
    found = repair.extract_locator("error_message", "old_locator")
    return failures_src(spark, d).select("id", repair.normalize_locator(found).alias("selector"))


@query
def extract_wait_call(spark, d):
    return failures_src(spark, d).select(
        "id", repair.extract_wait_call("error_message", "old_locator").alias("wait_call")
    )


@query
def upgrade_wait(spark, d):
    call = repair.extract_wait_call("error_message", "old_locator")
    return failures_src(spark, d).select("id", repair.upgrade_wait(call).alias("new_wait"))


@query
def fallback_old_value(spark, d):
    cause = repair.playbook_cause("root_cause")
    return failures_src(spark, d).select(
        "id", repair.fallback_old_value(cause, "old_locator").alias("old_value")
    )


@query
def repair_playbook(spark, d):
    cause = repair.playbook_cause("root_cause")
    fields = ["repair_type", "status", "developer_alert", "recommendation"]
    return failures_src(spark, d).select(
        "id", *[repair.playbook_field(cause, f).alias(f) for f in fields]
    )


HEAL_FIELDS = [
    "healing_id", "repair_type", "old_value", "new_value", "recommendation", "status", "developer_alert",
]


@query
def heal_rows(spark, d):
    return healed(spark, d).select("test_id", *[F.col(f"healing.{f}").alias(f) for f in HEAL_FIELDS])


QUERIES["heal"] = QUERIES.pop("heal_rows")


@query
def heal_fallback(spark, d):
    return heal(view(spark, d, "gaps_src")).select(
        "test_id", *[F.col(f"healing.{f}").alias(f) for f in HEAL_FIELDS]
    )


@query
def make_ids(spark, d):
    return failures_src(spark, d).select(
        "test_id",
        make_id("H", "test_id").alias("healing_id"),
        make_id("N", "test_id", 8).alias("notification_id"),
    )


# --- flakiness --------------------------------------------------------------------------

def _score():
    return flaky_f.instability_score(
        "retry_count", "failure_type", "failure_stage", "severity", "test_duration_sec"
    )


@query
def instability_score(spark, d):
    return failures_src(spark, d).select("id", _score().alias("score"))


@query
def risk_level(spark, d):
    return instability_score(spark, d).select("id", flaky_f.risk_level("score").alias("risk_level"))


@query
def flaky_flag(spark, d):
    return instability_score(spark, d).select("id", flaky_f.is_flaky("score").alias("is_flaky"))


@query
def score_percent_text(spark, d):
    return instability_score(spark, d).select("id", percent_text_cut("score").alias("score_text"))


FLAKY_FIELDS = ["is_flaky", "flaky_probability", "risk_level", "instability_score"]


@query
def check_flaky(spark, d):
    return flaky.check_flaky(failures_src(spark, d)).select(
        "test_id", "test_name", *[F.col(f"flaky_analysis.{f}").alias(f) for f in FLAKY_FIELDS]
    )


@query
def flaky_fallback(spark, d):
    return flaky.check_flaky(view(spark, d, "gaps_src")).select(
        "test_id", *[F.col(f"flaky_analysis.{f}").alias(f) for f in FLAKY_FIELDS]
    )


@query
def recent_pattern(spark, d):
    return flaky.recent_pattern(failures_src(spark, d)).select("test_name", "recent_pattern")


@query
def flip_rate(spark, d):
    return flaky.flip_rate(failures_src(spark, d)).select(
        "test_name", "runs", "flips", F.round("flip_rate", 6).alias("flip_rate")
    )


@query
def explode_pattern(spark, d):
    return flaky.explode_pattern(recent_pattern(spark, d)).select("test_name", "position", "outcome")


# --- alerts -----------------------------------------------------------------------------

@query
def alert_filter(spark, d):
    return alerts.alert_filter(healed(spark, d)).select("test_id", "root_cause")


@query
def alert_message(spark, d):
    message = alerts.alert_message("test_name", "root_cause", "confidence", "healing.recommendation")
    return healed(spark, d).select("test_id", message.alias("message"))


@query
def route_target(spark, d):
    requested = F.when(F.col("severity") == "HIGH", "manager").when(F.col("severity") == "LOW", "ops")
    return failures_src(spark, d).select("test_id", alerts.route_target("root_cause", requested).alias("target"))


@query
def target_label(spark, d):
    return route_target(spark, d).select("test_id", alerts.target_label("target").alias("label"))


@query
def notifications_by_target(spark, d):
    notes = store.table_rows(triage(failures_src(spark, d), target="auto"))["notifications"]
    return alerts.notifications_by_target(notes)


# --- triage -----------------------------------------------------------------------------

def flat_triage(df: DataFrame) -> DataFrame:
    return df.select(
        "test_id",
        F.col("classification.root_cause").alias("root_cause"),
        F.col("classification.confidence").alias("confidence"),
        *[F.col(f"healing.{f}").alias(f) for f in HEAL_FIELDS],
        *[F.col(f"flaky_analysis.{f}").alias(f) for f in FLAKY_FIELDS],
        F.col("notification.notification_id").alias("notification_id"),
        F.col("notification.message").alias("message"),
        F.col("notification.target").alias("target"),
    )


@query
def triage_rows(spark, d):
    return flat_triage(analyzed(spark, d))


QUERIES["triage"] = QUERIES.pop("triage_rows")


# --- lookups, joins, changes -------------------------------------------------------------

@query
def lookup_failure(spark, d):
    return tables.lookup_failures(stored(spark, d)["failures"], key_list(spark, d)).select(
        "id", "test_id", "root_cause", "status"
    )


def _saved_halves(spark, d) -> str:
    """A store of two batches: failures up to the middle of the month, and later ones."""
    root, late = store.scratch_dir(spark, "store"), F.col("created_at") >= F.lit("2024-01-16").cast("timestamp")
    rows = analyzed(spark, d)
    store.persist_fanout(rows.filter(late), root, "late", cache=False)
    store.persist_fanout(rows.filter(~late), root, "early", cache=False)
    return root


@query
def lookup_stored(spark, d):
    """The lookup in a store, which reads only the batches whose key filter holds a key."""
    return tables.store_lookup(spark, _saved_halves(spark, d), key_list(spark, d)).select("id", "test_id", "root_cause", "status")


@query
def incident_view(spark, d):
    t = stored(spark, d)
    rows = tables.incident_view(t["failures"], t["healing_actions"], t["flaky_tests"], t["notifications"])
    return rows.select(
        "test_id", "root_cause", "confidence",
        F.col("repair.repair_type").alias("repair_type"),
        F.col("repair.new_value").alias("new_value"),
        F.col("flaky.risk_level").alias("risk_level"),
        F.col("notification.message").alias("message"),
    )


@query
def apply_heal(spark, d):
    t = stored(spark, d)
    failures, healing = tables.apply_heal(t["failures"], t["healing_actions"], key_list(spark, d))
    return failures.select(F.lit("failures").alias("table_name"), "id", "status", "healing").unionByName(
        healing.select(
            F.lit("healing_actions").alias("table_name"), "id", "status",
            F.lit(None).cast("string").alias("healing"),
        )
    )


@query
def delete_cascade(spark, d):
    left = tables.delete_cascade(stored(spark, d), key_list(spark, d))
    parts = [
        df.select(F.lit(name).alias("table_name"), F.col(schemas.FAILURE_KEYS[name]).alias("test_id"))
        for name, df in left.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def delete_one(spark, d):
    t = stored(spark, d)
    keys = key_list(spark, d)
    healing = tables.delete_one(
        t["healing_actions"], keys.select(make_id("H", "test_id").alias("healing_id")), "healing_id"
    )
    flaky_left = tables.delete_one(
        t["flaky_tests"], keys.select(F.col("test_id").alias("test_code")), "test_code"
    )
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    notes = tables.delete_one(t["notifications"], ids, "id")
    parts = [("healing_actions", healing), ("flaky_tests", flaky_left), ("notifications", notes)]
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(n).alias("table_name"), "id") for n, df in parts]
    )


@query
def missing_keys(spark, d):
    return tables.missing_keys(key_list(spark, d), stored(spark, d)["failures"])


@query
def add_created_at(spark, d):
    rows = stored(spark, d)["failures"].withColumn(
        "created_at", F.when(F.col("healing") == "Pending", F.col("created_at"))
    )
    return store.add_created_at(rows, AS_OF).select(
        "id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    )


# --- reports ----------------------------------------------------------------------------

@query
def summary_counts(spark, d):
    return reports.summary_counts(stored(spark, d))


@query
def failure_trend(spark, d):
    return reports.failure_trend(failures_src(spark, d), AS_OF)


@query
def failure_trend_fallback(spark, d):
    # Ten years after the data, so that nothing falls into the window.
    return reports.failure_trend(failures_src(spark, d), "2034-01-30 23:59:59", fallback=True)


@query
def root_cause_breakdown(spark, d):
    return reports.root_cause_breakdown(stored(spark, d)["failures"])


@query
def counted_store(spark, d):
    """Totals, causes, days and risk levels of a store after repairs and deletions, from its counters."""
    root, keys = _saved(spark, d), key_list(spark, d)
    tables.store_heal(spark, root, keys, "healed")
    tables.store_delete(spark, root, _every_third(keys), "deleted")
    counts = store.counters(spark, root)
    totals = reports.summary_from_counters(counts)
    totals = totals.unpivot([], totals.columns, "name", "value")
    parts = {
        "summary": totals, "cause": reports.breakdown_from_counters(counts), "risk": reports.risk_from_counters(counts),
        "trend": reports.trend_from_counters(counts, AS_OF).withColumnRenamed("failures", "value"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("report"), "name", F.col("value").cast("bigint").alias("value")) for k, df in parts.items()])


@query
def risk_distribution(spark, d):
    return reports.risk_distribution(stored(spark, d)["flaky_tests"])


@query
def risk_share(spark, d):
    return reports.risk_share(stored(spark, d)["flaky_tests"])


@query
def avg_instability(spark, d):
    rows = stored(spark, d)["flaky_tests"]
    first = reports.page(rows, [F.desc("id")])
    return (
        reports.avg_instability(first).withColumn("scope", F.lit("page"))
        .unionByName(reports.avg_instability(rows).withColumn("scope", F.lit("all")))
        .select("scope", "average_score")
    )


@query
def high_risk_count(spark, d):
    return reports.high_risk_count(stored(spark, d)["flaky_tests"])


@query
def class_distribution(spark, d):
    return reports.class_distribution(view(spark, d, "runs_src"), "failure_type")


@query
def missing_profile(spark, d):
    return reports.missing_profile(dirty(spark, d))


@query
def shape_profile(spark, d):
    return reports.shape_profile(view(spark, d, "runs_src"))


@query
def sample_messages(spark, d):
    rows = view(spark, d, "runs_src").select("run_id", "failure_type", "error_message")
    return reports.head(rows, [F.col("run_id")], 10)


@query
def recent_failures(spark, d):
    return reports.recent_failures(stored(spark, d)["failures"])


@query
def page_failures(spark, d):
    rows = reports.page(stored(spark, d)["failures"], [F.desc("created_at"), F.desc("id")], 3)
    return rows.select("id", "test_id", "root_cause", "total", "page", "page_size")


@query
def page_stored(spark, d):
    """Deep pages of a store: its counters name the hours and id ranges to read."""
    root = _saved_halves(spark, d)
    pages = [
        store.page(spark, root, name, number).select(F.lit(name).alias("table_name"), "id", "total", "page", "page_size")
        for name, number in (("failures", 70), ("notifications", 20))
    ]
    return reduce(DataFrame.unionByName, pages)


@query
def page_healing(spark, d):
    rows = reports.page(stored(spark, d)["healing_actions"], [F.desc("id")], 2)
    return rows.select("id", "healing_id", "status", "total", "page", "page_size")


@query
def page_flaky(spark, d):
    rows = reports.page(stored(spark, d)["flaky_tests"], [F.desc("id")], 2)
    return rows.select("id", "test_code", "risk_level", "total", "page", "page_size")


@query
def page_notifications(spark, d):
    rows = reports.page(stored(spark, d)["notifications"], [F.desc("id")], 2)
    return rows.select("id", "failure_test_id", "target", "total", "page", "page_size")


@query
def page_after(spark, d):
    return reports.page_after(stored(spark, d)["notifications"], 900).select("id", "failure_test_id", "target")


@query
def total_pages(spark, d):
    return reports.total_pages(stored(spark, d)["failures"])


@query
def rank_probabilities(spark, d):
    names = F.array(*[F.lit(c) for c in vocab.ROOT_CAUSES])
    share = F.transform(
        names,
        lambda c: F.round(
            F.conv(F.substring(F.md5(F.concat(c, F.col("id").cast("string"))), 1, 4), 16, 10).cast("double")
            / F.lit(65536.0),
            4,
        ),
    )
    rows = failures_src(spark, d).select("id", F.map_from_arrays(names, share).alias("all_probabilities"))
    return reports.rank_probabilities(rows, "id").select(
        "id", F.col("rank").cast("bigint").alias("rank"), "root_cause", "probability"
    )


# --- sampling ---------------------------------------------------------------------------

@query
def cap_per_class(spark, d):
    return sampling.cap_per_class(
        failures_src(spark, d), "root_cause", "test_id", classes=vocab.ROOT_CAUSES
    ).select("test_id", "root_cause")


@query
def seeded_shuffle(spark, d):
    return sampling.seeded_shuffle(failures_src(spark, d), "test_id").select(
        "test_id", draw("shuffle", "test_id").alias("sort_key")
    )


@query
def stratified_split(spark, d):
    return sampling.stratified_split(
        failures_src(spark, d), "root_cause", "test_id", classes=vocab.ROOT_CAUSES
    ).select("test_id", "root_cause", "side")


@query
def threshold_split(spark, d):
    return sampling.stratified_split(
        failures_src(spark, d), "root_cause", "test_id", exact=False
    ).select("test_id", "side")


@query
def class_weights(spark, d):
    weights = sampling.class_weights(failures_src(spark, d), "root_cause")
    return weights.select("root_cause", "count", F.round("weight", 6).alias("weight"))


# --- features ---------------------------------------------------------------------------

def documents(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


@query
def tokenize_terms(spark, d):
    rows = features.tokenize_terms(documents(spark, d), "text")
    return rows.select(
        "doc_id", F.size("terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join("terms", "|")).alias("terms_md5"),
    )


def _vocabulary(spark, d):
    words = documents(spark, d).select("doc_id", features.words("text").alias("_words"))
    return features.word_vocabulary(words, "doc_id", 500)


@query
def vocabulary_topk(spark, d):
    return _vocabulary(spark, d)


@query
def idf_table(spark, d):
    return features.idf_table(_vocabulary(spark, d), documents(spark, d)).select(
        "term", "df", F.round("idf", 6).alias("idf")
    )


@query
def tfidf(spark, d):
    rows = features.tfidf(documents(spark, d), "doc_id", "text", 500)
    return rows.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_baseline(spark, d):
    rows = features.tfidf(
        documents(spark, d), "doc_id", "text", 5000, bigrams=False, sublinear=False,
        stop_words=features.english_stop_words(spark),
    )
    return rows.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def remove_stop_words(spark, d):
    kept = features.remove_stop_words(features.words("text"), features.english_stop_words(spark))
    rows = documents(spark, d).select("doc_id", kept.alias("kept"))
    return rows.select(
        "doc_id", F.size("kept").cast("bigint").alias("n_kept"),
        F.md5(F.array_join("kept", "|")).alias("kept_md5"),
    )


@query
def ordinal_encode(spark, d):
    """Codes come from the failed runs; types that only passed runs have are unseen."""
    rows = failures_src(spark, d)
    failed = rows.filter("outcome = 'FAIL'")
    fitted = {c: features.category_codes(failed, c) for c in models.CATEGORY_COLUMNS}
    return features.ordinal_encode(rows, fitted).select("id", *[f"{c}_code" for c in fitted])


@query
def label_encode(spark, d):
    rows = failures_src(spark, d).select("id", "root_cause")
    codes = features.category_codes(rows, "root_cause")
    coded = features.ordinal_encode(rows, {"root_cause": codes}).drop("root_cause")
    return features.label_decode(coded, codes, "root_cause_code", "decoded").select(
        "id", "root_cause_code", "decoded"
    )


def embeddings(spark, d):
    return table(spark, d, "embeddings")


@query
def smote_knn(spark, d):
    near = oversample.knn_within_class(embeddings(spark, d), "label", "vec_id", "embedding")
    return near.select("label", "vec_id", "rank", "neighbor", F.round("distance", 5).alias("distance"))


@query
def smote(spark, d):
    made = oversample.smote(embeddings(spark, d), "label", "vec_id", "embedding")
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    return made.select(
        "label", "base", "copy", "neighbor",
        F.round(F.get("vector", F.lit(0)), 5).alias("first_value"), F.round(total, 4).alias("total"),
    )


# --- models -----------------------------------------------------------------------------
#
# What a model learns cannot be said in SQL. These queries return what can: how many rows
# each class was tested on, whether all measures are shares, whether the model beats the
# largest class, and whether scored rows agree with themselves.

def with_prepared(fn, **options):
    """Pass the query a training set made of all failures, and release it afterwards."""

    def run(spark, d):
        p = TrainingSet(failures_src(spark, d), **options)
        try:
            return store.cut(fn(spark, d, p), fn.__name__)  # lazy parts still need the kept rows
        finally:
            p.release()

    run.__name__ = fn.__name__
    return run


def with_all_prepared(fn):
    """As ``with_prepared``, but features and classifiers are fitted on every training row."""
    return with_prepared(fn, cap=None)


def judged(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(class, support, in_range, beats_majority) from a table of all metrics."""
    shares = metrics.filter("metric <> 'support'")
    in_range = shares.agg(F.bool_and(F.col("value").between(0, 1)).alias("ok")).scalar()
    supports = metrics.filter("metric = 'support'").select("class", F.col("value").cast("bigint").alias("support"))
    largest = supports.agg(F.max("support") / F.sum("support")).scalar()
    accuracy_ = metrics.filter("metric = 'accuracy'").agg(F.max("value")).scalar()
    return supports.filter("support > 0").select(
        "class", "support", in_range.alias("in_range"), (accuracy_ > largest).alias("beats_majority")
    )


def agrees(scored: DataFrame) -> DataFrame:
    """Per scored row whether cause, confidence and probabilities fit together."""
    values = F.map_values("all_probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        "test_id", F.col("root_cause").isin(vocab.ROOT_CAUSES).alias("known_cause"),
        (F.col("confidence") == F.array_max(values)).alias("confidence_is_largest"),
        (F.element_at("all_probabilities", F.col("root_cause")) == F.col("confidence")).alias("cause_is_likeliest"),
        (F.abs(total - 1) < 1e-3).alias("sums_to_one"), "model_used",
    )


@query
@with_prepared
def assemble_features(spark, d, p):
    """Every failure's vector; its last entries are the numbers as they were given."""
    values = vector_to_array("features")
    last = {c: F.element_at("v", i - len(models.NUMBER_COLUMNS)) for i, c in enumerate(models.NUMBER_COLUMNS)}
    text = F.slice("v", F.lit(1), F.size("v") - F.lit(len(models.CATEGORY_COLUMNS) + len(last)))
    length = F.aggregate(text, F.lit(0.0), lambda a, x: a + x * x)
    return p.features().select("test_id", values.alias("v")).select(
        "test_id", *[F.round(x, 4).alias(c) for c, x in last.items()],
        # Two texts of length one each, unless a text has no known word.
        (F.abs(length - F.round(length)) < 1e-6).alias("unit_texts"),
    )


@query
@with_all_prepared
def train_random_forest(spark, d, p):
    return judged(report(models.train_random_forest(p.train), p.test(), "RandomForest"))


@query
@with_prepared
def train_gradient_boosting(spark, d, p):
    return judged(report(models.train_gradient_boosting(p.train), p.test(), "GradientBoosting"))


def baseline(spark, d, columns, fit):
    """Judged metrics of a baseline on raw runs, by failure type."""
    rows = clean.project_dropna(view(spark, d, "runs_src"), ["run_id", *columns, "failure_type"])
    split = sampling.stratified_split(rows, "failure_type", "run_id")
    train = bounded(split.filter("side = 'train'"), "failure_type", "run_id")
    try:
        model = fit(train)
        back = IndexToString(inputCol="prediction", outputCol="guess", labels=model_labels(model))
        scored = back.transform(model.transform(split.filter("side = 'test'")))
        return judged(store.cut(evaluate.metrics_table(scored, "Baseline", "failure_type", "guess"), "baseline"))
    finally:
        train.unpersist()


def model_labels(model) -> list[str]:
    """Class names in index order; a row of an unknown class keeps its own index."""
    indexers = [s for s in model.stages if isinstance(s, StringIndexerModel) and "label" in (s.getOrDefault("outputCol"),)]
    return [*indexers[-1].labels, "unknown"]


@query
def train_text_baseline(spark, d):
    return baseline(spark, d, ["error_message"], lambda train: models.train_text_baseline(train, "run_id"))


@query
def train_structured_baseline(spark, d):
    columns = models.STRUCTURED_TEXT + models.STRUCTURED_NUMBERS
    return baseline(spark, d, columns, models.train_structured_baseline)


@query
@with_prepared
def vote_ensemble(spark, d, p):
    """Forest and boosted trees, with their usual sizes, vote on the whole test side."""
    forest = models.train_random_forest(p.train)
    boosted = models.train_gradient_boosting(p.train)
    voted = models.vote_ensemble(
        p.test_rows.withColumnRenamed("root_cause", "truth"), p.stages, [forest, boosted]
    )
    return judged(evaluate.metrics_table(voted, "Ensemble", "truth", "root_cause"))


@query
@with_all_prepared
def tune_grid(spark, d, p):
    fitted = models.tune_grid(p.train)
    rows = [
        tuple(int(v) for v in sorted_params(grid)) + (bool(0 < score <= 1),)
        for grid, score in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)
    ]
    return spark.createDataFrame(rows, "max_depth int, num_trees int, accuracy_in_range boolean")


def sorted_params(grid) -> list:
    """Values of one grid point in parameter-name order (maxDepth, numTrees)."""
    return [v for _, v in sorted((p.name, v) for p, v in grid.items())]


@query
@with_prepared
def score_failures(spark, d, p):
    forest = models.train_random_forest(p.train)
    return agrees(models.score_failures(failures_src(spark, d), p.stages, forest))


@query
@with_prepared
def score_gaps(spark, d, p):
    """Rows that lack texts, numbers or categories are scored like all others."""
    forest = models.train_random_forest(p.train)
    lacks = {"error_message": 2, "stack_trace": 3, "retry_count": 5, "failure_type": 7, "memory_usage_mb": 11}
    rows = failures_src(spark, d).withColumns({c: F.when(F.col("id") % n != 0, F.col(c)) for c, n in lacks.items()})
    return agrees(models.score_failures(rows, p.stages, forest))


@query
@with_prepared
def triage_scored(spark, d, p):
    """The whole analysis with the model's cause in place of the given one."""
    forest = models.train_random_forest(p.train)
    done = triage(models.score_failures(failures_src(spark, d), p.stages, forest))
    return done.select(
        "test_id", F.col("classification.model_used").alias("model_used"),
        (F.col("classification.root_cause") == F.col("root_cause")).alias("same_cause"),
        F.col("healing.repair_type").isNotNull().alias("has_repair"),
        F.col("flaky_analysis.instability_score").alias("instability_score"),
        (F.col("notification").isNotNull() == F.col("healing.developer_alert")).alias("alert_sent"),
    )


@query
@with_prepared
def analyze_uploads(spark, d, p):
    """Uploaded files to analyzed failures: route, require, identify, score, triage."""
    forest = models.train_random_forest(p.train)
    done, _ = analyze(view(spark, d, "uploads_src"), p.stages, forest)
    return done.select(
        "test_id", "test_name", "error_message", "failure_stage", "severity",
        F.col("root_cause").isin(vocab.ROOT_CAUSES).alias("known_cause"),
        F.col("healing.healing_id").alias("healing_id"), F.col("flaky_analysis.risk_level").alias("risk_level"),
    )


@query
@with_prepared
def save_model(spark, d, p):
    """Scores of a model and of the same model saved and loaded: rows, and rows that differ."""
    forest = models.train_random_forest(p.train)
    path = store.scratch_dir(spark, "model")
    models.save_model(p.stages, forest, path)
    stages, loaded = models.load_model(path)
    first = models.score_failures(p.test_rows, p.stages, forest).select("test_id", "root_cause", "confidence")
    again = models.score_failures(p.test_rows, stages, loaded).select(
        "test_id", F.col("root_cause").alias("cause2"), F.col("confidence").alias("confidence2")
    )
    differs = (F.col("root_cause") != F.col("cause2")) | (F.col("confidence") != F.col("confidence2"))
    return first.join(again, "test_id").agg(F.count("*").alias("n_rows"), F.count_if(differs).alias("n_differ"))


@query
def metrics_json(spark, d):
    path = store.scratch_dir(spark, "metrics")
    models.write_metrics_json(evaluate.metrics_table(predictions(spark, d), "rule"), path)
    return models.read_metrics_json(spark, path)


@query
def confidence_text(spark, d):
    return failures_src(spark, d).select("id", percent_text("confidence").alias("confidence"))


# --- evaluation -------------------------------------------------------------------------

@query
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(predictions(spark, d), vocab.ROOT_CAUSES)


@query
def accuracy(spark, d):
    return evaluate.accuracy(predictions(spark, d))


@query
def per_class_metrics(spark, d):
    return evaluate.per_class_metrics(predictions(spark, d))


@query
def macro_metrics(spark, d):
    return evaluate.macro_metrics(predictions(spark, d))


@query
def weighted_f1(spark, d):
    return evaluate.weighted_f1(predictions(spark, d))


def _compared(spark, d):
    return evaluate.model_comparison(
        {"RandomForest": second_predictions(spark, d), "GradientBoosting": predictions(spark, d)}
    )


@query
def model_comparison(spark, d):
    return _compared(spark, d)


@query
def select_best(spark, d):
    return evaluate.select_best(_compared(spark, d))


@query
def metric_band(spark, d):
    table_ = evaluate.metrics_table(predictions(spark, d), "rule").filter("metric <> 'support'")
    return reports.metric_band(table_).select("class", "metric", "value", "band")


# --- streams ----------------------------------------------------------------------------

def _stream_source(spark, d, repeat: bool = False):
    """Failures as JSON files in time order; with ``repeat`` failed ones come twice."""
    path = store.scratch_dir(spark, "stream-in")
    rows = failures_src(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    if repeat:
        rows = rows.unionByName(rows.filter("outcome = 'FAIL'"))
    rows.repartitionByRange(4, "created_at").write.mode("overwrite").json(path)
    return jobs.failure_stream(spark, path, rows.schema), rows


@query
def stream_triage(spark, d):
    stream, _ = _stream_source(spark, d)
    root = store.scratch_dir(spark, "stream-store")
    jobs.stream_triage(stream, root, store.scratch_dir(spark, "checkpoint")).awaitTermination()
    return content(spark, root)


@query
@with_prepared
def stream_scored(spark, d, p):
    """The stream finds each failure's cause with a model before it is analyzed."""
    forest = models.train_random_forest(p.train)
    stream, _ = _stream_source(spark, d)
    root = store.scratch_dir(spark, "stream-store")
    score = lambda batch: models.score_failures(batch, p.stages, forest)
    jobs.stream_triage(stream, root, store.scratch_dir(spark, "checkpoint"), score=score).awaitTermination()
    return store.scan_table(spark, root, "failures").select("test_id", F.col("root_cause").isin(vocab.ROOT_CAUSES).alias("known_cause"))


@query
def stream_dedupe(spark, d):
    stream, _ = _stream_source(spark, d, repeat=True)
    out = store.scratch_dir(spark, "stream-out")
    jobs.stream_dedupe(stream, out, store.scratch_dir(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("test_id", "root_cause", "outcome")


@query
def stream_trend(spark, d):
    stream, _ = _stream_source(spark, d)
    out = store.scratch_dir(spark, "stream-out")
    jobs.stream_trend(stream, out, store.scratch_dir(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "failures")


@query
def stream_recent_pattern(spark, d):
    stream, _ = _stream_source(spark, d)
    out = store.scratch_dir(spark, "stream-out")
    jobs.stream_recent_pattern(stream, out, store.scratch_dir(spark, "checkpoint")).awaitTermination()
    return jobs.read_recent_pattern(spark, out)
