"""Column functions that several operators share."""

from fieldloom.functions.vectors import barycentric, corner, gap, heron, normal, uniform

__all__ = ["barycentric", "corner", "gap", "heron", "normal", "uniform"]
