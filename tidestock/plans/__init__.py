"""User-level jobs assembled from the operators."""
