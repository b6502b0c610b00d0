"""Column functions: cleanup and JSON extraction."""
