"""Spatial sensor-fusion analytics as DataFrame transformations."""
