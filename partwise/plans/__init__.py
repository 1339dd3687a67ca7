"""Named compositions of the operators."""
