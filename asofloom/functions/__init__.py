"""Primitives: aggregations of child rows and transformations of an entity's own rows."""
