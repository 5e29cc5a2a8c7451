"""Registry-graph operators."""
