"""Runnable queries of the core."""

from __future__ import annotations

import importlib

CORE = ("pipeline", "graph_queries", "search_queries", "resolve_queries", "change_queries")


def core_registries() -> list:
    return [importlib.import_module(f"arbora.plans.{m}").R for m in CORE]
