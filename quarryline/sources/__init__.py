"""Readers and writers."""

from quarryline.sources.tables import table, until_middle

__all__ = ["table", "until_middle"]
