"""fieldloom: scalar fields, meshes, diagrams and catalogs as Spark DataFrames."""

__version__ = "0.1.0"
