"""DataFrame operators, one module per step of the work."""
