"""Importing this module registers every plan."""

from millrace.plans import curation, profiling, records, scoring  # noqa: F401
