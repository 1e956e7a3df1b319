"""operators of the catalog library."""
