"""DataFrame operators; see README.md for the map from names to modules."""
