"""Registered queries of the library, by area."""

from dutymark.queries import flows, lookups, master, scalars, similarity  # noqa: F401
