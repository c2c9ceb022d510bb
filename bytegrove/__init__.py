"""bytegrove: analytics over compiled-code metadata (and the text tables beside it) on Spark."""

__version__ = "0.1.0"
