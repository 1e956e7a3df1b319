"""sources of the catalog library."""
