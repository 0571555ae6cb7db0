"""Report plans built from the operators."""
