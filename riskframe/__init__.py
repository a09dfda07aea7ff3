"""Time-based risk datasets on Spark: spines, point-in-time joins, labels, rolling
features, encoders and evaluation, every step a DataFrame -> DataFrame function."""

__version__ = "0.1.0"
