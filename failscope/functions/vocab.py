"""Class names, rule texts, routing and display tables.

Everything here must equal the published behaviour letter for letter, because it
appears in results. There is no logic in this module.
"""

# --- root causes -----------------------------------------------------------------
ROOT_CAUSES = [
    "application_defect",
    "environment_failure",
    "locator_issue",
    "network_api_error",
    "synchronization_issue",
    "test_data_issue",
]
DEFECT = "application_defect"

# --- repair rules ----------------------------------------------------------------
# Locator patterns, tried in this order.
LOCATOR_PATTERNS = [
    r"#[\w-]+",
    r"\.[\w-]+",
    r"xpath=.+",
    r"//\w+\[.+\]",
    r"By\.(id|cssSelector|xpath)\(",
]
LOCATOR_PLACEHOLDERS = ["", "N/A", "hardcoded/stale test data"]
LOCATOR_UNKNOWN = "#unknown-locator"

# Fragile wait call -> explicit wait, tried in this order.
WAIT_UPGRADES = {
    "time.sleep(": "WebDriverWait(driver, 15).until(EC.visibility_of_element_located(locator))",
    "implicitly_wait": "WebDriverWait(driver, 20).until(EC.element_to_be_clickable(locator))",
    "wait(": "WebDriverWait(driver, 15).until(EC.presence_of_element_located(locator))",
    "Thread.sleep": "WebDriverWait(driver, 15, poll_frequency=0.5).until(EC.visibility_of_element_located(locator))",
}
WAIT_PLACEHOLDERS = ["", "N/A"]
WAIT_UNKNOWN = "time.sleep(2)"
WAIT_DEFAULT_UPGRADE = (
    "WebDriverWait(driver, 15).until(EC.visibility_of_element_located(locator))"
)

# What stands in for the old value when the input names none.
OLD_VALUE_DEFAULTS = {
    "test_data_issue": "hardcoded / stale test data",
    "environment_failure": "environment service down",
    "network_api_error": "direct API call without retry",
    "application_defect": "N/A",
}

# cause -> repair type, status, alert, fixed new value (None: computed), recommendation
PLAYBOOK = {
    "locator_issue": dict(
        repair_type="Locator Repair",
        status="Suggested",
        developer_alert=False,
        new_value=None,
        recommendation=(
            "Update the failing element locator to use a stable data-testid or aria-label "
            "attribute instead of fragile CSS id/class selectors. Verify the new locator "
            "against the current DOM structure before committing."
        ),
    ),
    "synchronization_issue": dict(
        repair_type="Wait Strategy Upgrade",
        status="Suggested",
        developer_alert=False,
        new_value=None,
        recommendation=(
            "Replace fixed sleep/implicit waits with explicit WebDriverWait conditions. "
            "Use EC.visibility_of_element_located() or EC.element_to_be_clickable() "
            "to make the test resilient to page-load timing variations."
        ),
    ),
    "test_data_issue": dict(
        repair_type="Test Data Refresh",
        status="Pending",
        developer_alert=True,
        new_value="@BeforeEach dynamic test data setup",
        recommendation=(
            "Re-seed the test database with fresh test data before execution. "
            "Use @BeforeEach setup methods or test data factories to ensure "
            "isolated and reproducible test state."
        ),
    ),
    "environment_failure": dict(
        repair_type="Environment Retry",
        status="Pending",
        developer_alert=True,
        new_value="retry after environment health check",
        recommendation=(
            "Retry after verifying test environment health. Check that all required "
            "services (database, Docker containers, Selenium Grid) are running. "
            "Consider adding a pre-test smoke check."
        ),
    ),
    "network_api_error": dict(
        repair_type="Network Retry with Backoff",
        status="Pending",
        developer_alert=True,
        new_value="retry with exponential backoff (max 3 attempts)",
        recommendation=(
            "Add retry logic with exponential backoff for transient network failures. "
            "Consider mocking external API calls in test environments to isolate "
            "the test from network instability."
        ),
    ),
    "application_defect": dict(
        repair_type="Developer Alert",
        status="Rejected",
        developer_alert=True,
        new_value="N/A — requires developer fix",
        recommendation=(
            "This failure indicates an application-level defect. No automated repair "
            "is possible. A bug report has been raised for the development team."
        ),
    ),
}

# --- flakiness -------------------------------------------------------------------
FLAKY_TYPES = ["Timeout", "Network Error", "Test Failure"]
SEVERITY_WEIGHTS = {"LOW": 0.15, "MEDIUM": 0.10, "HIGH": 0.05, "CRITICAL": 0.0}
SEVERITY_OTHER = 0.05
RISK_LEVELS = ["High", "Medium", "Low"]

# --- alerts ----------------------------------------------------------------------
TARGET_LABELS = {
    "developer": "Software Developer",
    "devops": "DevOps Engineer",
    "manager": "Project Manager",
}
CAUSE_TARGETS = {
    "application_defect": "developer",
    "test_data_issue": "developer",
    "environment_failure": "devops",
    "network_api_error": "devops",
    "locator_issue": "developer",
    "synchronization_issue": "developer",
}

# --- dashboard -------------------------------------------------------------------
CAUSE_COLORS = {
    "locator_issue": "#60a5fa",
    "synchronization_issue": "#f59e0b",
    "test_data_issue": "#f97316",
    "environment_failure": "#a78bfa",
    "network_api_error": "#ef4444",
    "application_defect": "#ec4899",
}
OTHER_COLOR = "#6b7280"

# --- analyze input ---------------------------------------------------------------
INPUT_DEFAULTS = {
    "stack_trace": "",
    "logs": "",
    "failure_stage": "test",
    "failure_type": "Test Failure",
    "severity": "MEDIUM",
    "retry_count": 0.0,
    "test_duration_sec": 30.0,
    "cpu_usage_pct": 50.0,
    "memory_usage_mb": 1024.0,
    "is_flaky_test": 0,
    "old_locator": "",
}
UPLOAD_PIPELINE = "GitHub Actions"

# --- training set ----------------------------------------------------------------
# CI failure type -> root cause; anything else is an environment failure.
CATEGORY_CAUSES = {
    "Build Failure": "application_defect",
    "Test Failure": "application_defect",
    "Dependency Error": "environment_failure",
    "Network Error": "network_api_error",
    "Configuration Error": "environment_failure",
    "Resource Exhaustion": "environment_failure",
    "Timeout": "synchronization_issue",
    "Deployment Failure": "environment_failure",
    "Security Scan Failure": "environment_failure",
    "Permission Error": "environment_failure",
}
CATEGORY_OTHER = "environment_failure"

# Columns of the training set, in file order.
TRAINING_FIELDS = [
    "test_id", "test_name", "pipeline", "browser", "os", "language",
    "cloud_provider", "branch", "root_cause", "failure_stage", "failure_type",
    "error_message", "stack_trace", "severity", "old_value", "new_value",
    "retry_count", "test_duration_sec", "cpu_usage_pct", "memory_usage_mb",
    "is_flaky_test", "recommendation", "developer_alert", "timestamp",
]

GENERIC_MESSAGES = [
    "An unexpected error occurred during test execution.",
    "The operation timed out after 60 seconds.",
    "System.Exception: General failure detected in the testing pipeline.",
    "Failed to complete the action on the web application.",
    "Test runner encountered an unhandled exception.",
]
GENERIC_TRACE = "Exception at generic_handler.py"

TEXT_FILLS = {
    "error_message": "",
    "stack_trace": "",
    "failure_stage": "unknown",
    "severity": "MEDIUM",
    "failure_type": "unknown",
}
NUMBER_FILLS = {
    "retry_count": 0.0,
    "test_duration_sec": 30.0,
    "cpu_usage_pct": 50.0,
    "memory_usage_mb": 1024.0,
}

# Cell texts a pandas CSV reader takes as missing.
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
