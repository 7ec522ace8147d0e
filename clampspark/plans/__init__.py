"""Multi-operator plans: quality checks and step analysis."""
