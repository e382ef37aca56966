"""Chromosome-scale interval, contact and text analytics as PySpark DataFrame functions."""
