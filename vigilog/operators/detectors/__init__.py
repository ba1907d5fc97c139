"""Anomaly detectors: fit on a DataFrame, transform to raw score, confidence and flag."""
