"""functions of the catalog library."""
