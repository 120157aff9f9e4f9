"""Named queries; importing the package registers them."""

from fieldloom.plans import geometric, registry, relational, selection, tabular, topological

__all__ = ["geometric", "registry", "relational", "selection", "tabular", "topological"]
