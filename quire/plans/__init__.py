"""Queries over the test tables; importing the package fills REGISTRY."""

from quire.plans.registry import REGISTRY, Entry, query  # noqa: F401
from quire.plans import checks, documents, events, files, orders, pages, streams, work  # noqa: E402,F401
