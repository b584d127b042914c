"""Trusted profiles from messy records about the same people, on Spark."""

__all__ = ["Engine", "run_transform", "run_transform_with_metrics"]


def __getattr__(name: str):
    """The engine's names, loaded when asked for: Python workers import this package too."""
    if name in __all__:
        from .plans import engine

        return getattr(engine, name)
    raise AttributeError(name)
