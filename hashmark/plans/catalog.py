"""All queries of the core."""

from __future__ import annotations

from hashmark.plans import analysis, data_care, star, texts, warehouse
from hashmark.plans.registry import Registry


def registry() -> Registry:
    return Registry().merged(data_care.registry, warehouse.registry, analysis.registry, star.registry, texts.registry)
