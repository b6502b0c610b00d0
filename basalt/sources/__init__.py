"""Reading and exporting tables."""
