"""Operators for large training corpora: one module each, their queries in ``queries``."""
