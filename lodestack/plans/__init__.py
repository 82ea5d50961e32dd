"""Registered queries by family."""

from . import registry  # noqa: F401  first, so that families are imported in one order whichever is asked for
