"""Registries of algorithms and providers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Versions or providers by name; an unknown name is an error, and no name means the latest."""

    def __init__(self, what: str):
        self.what = what
        self.known: dict[Any, Callable] = {}

    def add(self, name: Any) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            if name in self.known:
                raise ValueError(f"{self.what} {name} is known already")
            self.known[name] = f
            return f

        return put

    def get(self, name: Any = None) -> Callable:
        if name is None and self.known:
            return self.known[max(self.known)]
        if name not in self.known:
            raise ValueError(f"no {self.what} {name}")
        return self.known[name]


#: Algorithms of list weights by version, and sources of matches by name.
WEIGHTS, PROVIDERS = Registry("weight calculator"), Registry("provider")
