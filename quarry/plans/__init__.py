"""Named queries of the catalog."""
