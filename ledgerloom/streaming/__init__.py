"""streaming of the catalog library."""
