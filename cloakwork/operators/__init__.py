"""Table-level operators, one module per family."""
