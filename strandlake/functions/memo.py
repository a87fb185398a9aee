"""A cache for pure functions that travels to executors with the function."""

from __future__ import annotations

from collections.abc import Callable


def memo(size: int) -> Callable:
    """Keep the results of up to ``size`` arguments; a full cache is emptied."""

    def wrap(f: Callable) -> Callable:
        kept: dict = {}

        def cached(*args):
            if args not in kept:
                if len(kept) >= size:
                    kept.clear()
                kept[args] = f(*args)
            return kept[args]

        cached.__doc__ = f.__doc__
        return cached

    return wrap
