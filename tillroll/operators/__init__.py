"""DataFrame -> DataFrame operators, one module per dashboard question."""
