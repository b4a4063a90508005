"""Security telemetry analytics as Spark DataFrame programs."""

__version__ = "0.1.0"
