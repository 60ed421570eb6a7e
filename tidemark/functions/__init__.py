"""Small column functions that the operators share."""
