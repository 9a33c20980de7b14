"""sources of postglean."""
