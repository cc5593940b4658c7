"""Waveform (value-change) analytics on Spark."""

from tracelake.api import compare, extract, find, list_signals, metadata, toggles
from tracelake.model import VERSION

__all__ = ["compare", "extract", "find", "list_signals", "metadata", "toggles"]
__version__ = VERSION
