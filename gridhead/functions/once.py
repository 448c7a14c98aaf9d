"""Columns that a stream builds once: building one takes a call to the JVM for each part of it, a second for those of a detection."""

from __future__ import annotations

import contextlib
import contextvars
import functools
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

_Made = TypeVar("_Made")
_built: contextvars.ContextVar[dict | None] = contextvars.ContextVar("built", default=None)


@contextlib.contextmanager
def building_once(built: dict) -> Iterator[None]:
    """Inside, what `once` marks is taken from `built` if it is there, and else left there for the next time."""
    token = _built.set(built)
    try:
        yield
    finally:
        _built.reset(token)


def once(make: Callable[..., _Made]) -> Callable[..., _Made]:
    """For makers of columns that name their inputs, so that they fit any table that has these."""

    @functools.wraps(make)
    def made(*args: Hashable) -> _Made:
        built = _built.get()
        if built is None:
            return make(*args)
        key = make.__module__, make.__qualname__, *args
        if key not in built:
            built[key] = make(*args)
        return built[key]

    return made
