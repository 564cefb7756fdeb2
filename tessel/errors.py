"""Errors of the engine."""


class UnsupportedPlanError(ValueError):
    """A request that the engine does not do; nothing is done in its place."""
