"""See the package README for the map of modules."""
