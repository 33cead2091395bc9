"""Release-calendar data-freshness analytics on Spark."""

__version__ = "0.2.0"
