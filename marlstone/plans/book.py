"""Registration of queries with their SQL oracles."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None):
        def keep(function):
            self.queries[name] = function
            if oracle:
                self.oracles[name] = oracle
            return function

        return keep
