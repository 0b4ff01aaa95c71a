"""The engine's queries over the driver's tables, each with its SQL counterpart where SQL can express it."""

from . import aggregates, base, checks, clustering, features, graph, records, relational, scale, series  # noqa: F401
