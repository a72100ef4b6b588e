"""Staged security-event analytics as plain Spark DataFrame operators."""

from stagewise.settings import Settings
from stagewise.sources.specs import SourceSpec

__all__ = ["Settings", "SourceSpec"]
