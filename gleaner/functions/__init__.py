"""Part of gleaner."""
