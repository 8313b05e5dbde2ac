"""Part of the textloom engine."""
