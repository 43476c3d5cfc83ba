"""Functions of columns, row by row."""
