"""Column builders: pure functions from columns to columns."""

from .exprs import *  # noqa: F403
