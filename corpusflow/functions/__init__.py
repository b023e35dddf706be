"""Column functions: nothing here reads a table or moves a row."""
