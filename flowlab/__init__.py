"""Spark jobs for network-flow tables: cleaning, profiling, splits, detectors, evaluation."""
