"""One module per family; each query applies an operator to the test tables."""
