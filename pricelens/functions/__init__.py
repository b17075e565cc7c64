"""Column functions of the domain; all are built-in expressions."""
