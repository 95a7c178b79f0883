"""Registered queries and their SQL twins."""

from . import answers, filed, found, marked, registry, runs, scanned

__all__ = ["answers", "filed", "found", "marked", "registry", "runs", "scanned"]
