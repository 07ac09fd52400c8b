"""Triage and analytics of CI test failures as Spark jobs."""

__version__ = "0.1.0"
