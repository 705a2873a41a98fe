"""Virtual rasters over ordinary tables, the query catalog, and the pair pipeline."""
