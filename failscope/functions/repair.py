"""Repair suggestion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .columns import UNICODE, col, first_filled, lookup


def _given(old_value: Column, placeholders: list[str]) -> Column:
    """The stated old value, or null where it is missing or a placeholder."""
    return F.when(~old_value.isin(placeholders), old_value)


def extract_locator(message, old_value) -> Column:
    """Broken locator: the stated one, else the first pattern that hits the message.

    Pattern order decides, not position in the text.
    """
    hits = [
        F.nullif(F.regexp_extract(col(message), UNICODE + p, 0), F.lit(""))
        for p in vocab.LOCATOR_PATTERNS
    ]
    return F.coalesce(
        _given(col(old_value), vocab.LOCATOR_PLACEHOLDERS), *hits, F.lit(vocab.LOCATOR_UNKNOWN)
    )


def normalize_locator(locator) -> Column:
    """Locator text to a stable ``[data-testid='...']`` selector."""
    dashed = F.regexp_replace(col(locator), "[^a-zA-Z0-9]", "-")
    name = F.lower(F.btrim(dashed, F.lit("-")))
    return F.concat(F.lit("[data-testid='"), name, F.lit("']"))


def extract_wait_call(message, old_value) -> Column:
    """Fragile wait call: the stated one, else the first known call in the message."""
    text = F.lower(col(message))
    found = None
    for call in vocab.WAIT_UPGRADES:
        hit = text.contains(call.lower())
        found = F.when(hit, call) if found is None else found.when(hit, call)
    return F.coalesce(
        _given(col(old_value), vocab.WAIT_PLACEHOLDERS), found, F.lit(vocab.WAIT_UNKNOWN)
    )


def upgrade_wait(call) -> Column:
    """Explicit wait for exactly this call; any other call gets the default wait."""
    return lookup(col(call), vocab.WAIT_UPGRADES, vocab.WAIT_DEFAULT_UPGRADE)


def playbook_cause(root_cause) -> Column:
    """Key into the playbook: lower case, unknown causes count as defects."""
    rc = F.lower(col(root_cause))
    return F.when(rc.isin(vocab.ROOT_CAUSES), rc).otherwise(F.lit(vocab.DEFECT))


def playbook_field(cause: Column, field: str) -> Column:
    return lookup(cause, {c: row[field] for c, row in vocab.PLAYBOOK.items()})


def playbook_row(cause: Column) -> Column:
    """All playbook fields of a cause as one struct, from a constant map."""
    rows = []
    for c, row in vocab.PLAYBOOK.items():
        fields = [F.lit(v).cast("boolean" if isinstance(v, bool) else "string").alias(f) for f, v in row.items()]
        rows += [F.lit(c), F.struct(*fields)]
    return F.element_at(F.create_map(*rows), cause)


def fallback_old_value(cause: Column, old_value) -> Column:
    """Old value for causes without extraction; here "N/A" counts as a value."""
    return first_filled(old_value, default=lookup(cause, vocab.OLD_VALUE_DEFAULTS))


def missing_input(root_cause, message, old_value) -> Column:
    """Name of the input without which no repair can be given, else null.

    The message is needed only if a locator or wait call has to be taken from it.
    """
    rc, message, old = F.lower(col(root_cause)), col(message), col(old_value)
    needs_message = (
        (rc == "locator_issue") & (old.isNull() | old.isin(vocab.LOCATOR_PLACEHOLDERS))
    ) | ((rc == "synchronization_issue") & (old.isNull() | old.isin(vocab.WAIT_PLACEHOLDERS)))
    return F.when(rc.isNull(), "root_cause").when(
        message.isNull() & needs_message, "error_message"
    )
