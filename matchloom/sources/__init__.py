"""sources of the reconciliation engine."""
