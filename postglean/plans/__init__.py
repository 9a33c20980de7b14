"""plans of postglean."""
