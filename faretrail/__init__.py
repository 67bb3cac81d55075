"""faretrail: fare-card journey, card-snapshot and rider-survey analytics on Spark."""

__version__ = "0.1.0"
