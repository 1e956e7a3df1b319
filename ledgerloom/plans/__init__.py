"""plans of the catalog library."""
