"""Registered queries."""

from lexweave.plans import queries, registry  # noqa: F401
