"""pitlab: point-in-time equity-research analytics as Spark DataFrame functions."""

__version__ = "0.1.0"
