"""Tributary: preparation and control of training data as Spark plans."""
