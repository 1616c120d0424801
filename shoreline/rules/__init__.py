"""Rule tables. Everything here is plain data; code lives elsewhere."""
