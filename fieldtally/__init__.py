"""Field-event analytics on Spark: typed event frames in, report frames out."""

__version__ = "0.1.0"
