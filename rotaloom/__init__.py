"""rotaloom: a PySpark-native engine for noisy, repeated observations of day schedules."""

__version__ = "0.1.0"
