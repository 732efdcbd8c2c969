"""Launch-demand analytics on Spark: event-aligned windows, features, models, calibration."""
