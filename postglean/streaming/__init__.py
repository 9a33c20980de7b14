"""streaming of postglean."""
