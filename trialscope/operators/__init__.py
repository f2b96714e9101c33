"""DataFrame -> DataFrame operators, one module per data family."""
