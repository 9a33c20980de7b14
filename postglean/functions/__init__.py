"""functions of postglean."""
