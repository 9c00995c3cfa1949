"""See README.md for the list of operators."""
