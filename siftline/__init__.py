"""siftline - DataFrame operators that triage large collections of text records."""

__version__ = "0.1.0"
