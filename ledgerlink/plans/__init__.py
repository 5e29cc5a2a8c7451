"""Query catalogue with SQL twins."""
