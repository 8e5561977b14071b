"""All queries over the standard tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provenant.plans import discovery, dossier, ingest, inputs, pipelines, records, research, text, writes

REGISTRIES = (research.registry, text.registry, writes.registry, ingest.registry, pipelines.registry, discovery.registry, records.registry, dossier.registry, inputs.registry)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for r in REGISTRIES for n, q in r.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for r in REGISTRIES for n, s in r.sql.items()}
