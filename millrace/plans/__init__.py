"""Plans of the retrieval engine."""
