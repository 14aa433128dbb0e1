"""Hourly building-meter analytics on Spark: clean, profile, impute, cluster and classify."""
