"""A registry of queries over the domain tables, each with the SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provenant.sources.fixtures import Domain, prelude

Plan = Callable[[Domain], DataFrame]


def counting(sql: str) -> str:
    """``count_if`` as a whole number that is 0, not null, where no row counts."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 1, start + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:start], "CAST(coalesce(", sql[start:end], ", 0) AS BIGINT)"]
        at = end
    return "".join([*out, sql[at:]])


class Registry:
    """Queries by name; ``sql`` is None where SQL cannot express one."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, plan: Plan, tables: tuple[str, ...], more: str, sql: str | None) -> None:
        """Register a plan; ``tables`` are the derived tables that its SQL reads, ``more`` further common tables."""
        self.plans[name] = plan
        if sql is not None:
            head = prelude(*tables) if tables else ""
            parts = [p.strip().strip(",") for p in (head, more) if p.strip()]
            text = ",\n".join(parts) if head else ("WITH " + parts[0] if parts else "")
            tail = sql.strip()
            if tail.startswith(",") and not text:
                text, tail = "WITH", tail[1:]
            self.sql[name] = counting(f"{text}{tail}" if tail.startswith(",") else f"{text}\n{tail}")

    def query(self, tables: tuple[str, ...], more: str, sql: str | None) -> Callable[[Plan], Plan]:
        def wrap(plan: Plan) -> Plan:
            self.add(plan.__name__, plan, tables, more, sql)
            return plan

        return wrap

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {n: (lambda spark, sf_dir, p=p: p(Domain(spark, sf_dir))) for n, p in self.plans.items()}
