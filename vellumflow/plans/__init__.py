"""Query modules; registries() lists those of the core."""

from __future__ import annotations

from vellumflow.plans.registry import Registry


def registries() -> list[Registry]:
    from vellumflow.plans import record_queries, reference_queries, training_core

    return [reference_queries.registry, record_queries.registry, training_core.registry]
