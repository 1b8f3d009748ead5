"""Registered queries: a Spark callable and, where possible, reference SQL."""

from importlib import import_module

MODULES = ("inputs", "rows", "telemetry", "joins", "health", "reports", "files")


def load_all() -> None:
    for name in MODULES:
        import_module(f"queries.{name}")
