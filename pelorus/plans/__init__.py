"""Plan helpers: lineage, sizes, objects and their order."""
