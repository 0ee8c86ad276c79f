"""functions of the reconciliation engine."""
