"""Registered queries over the fixture tables (see ``registry``)."""

from __future__ import annotations

import importlib

_MODULES = [
    "quarry.plans.trigger_plans",
    "quarry.plans.text_plans",
    "quarry.plans.overlap_plans",
    "quarry.plans.sampling_plans",
    "quarry.plans.sweep_plans",
    "quarry.plans.cluster_plans",
    "quarry.plans.clustering_plans",
    "quarry.plans.stream_plans",
    "quarry.plans.io_plans",
    "quarry.plans.curation_plans",
    "quarry.plans.sink_plans",
]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)
