"""Where a module's queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Run] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Run], Run]:
        def keep(run: Run) -> Run:
            self.queries[name] = run
            if oracle is not None:
                self.oracle[name] = oracle
            return run

        return keep
