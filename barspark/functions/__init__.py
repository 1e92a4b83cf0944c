"""Column builders and the window vocabulary shared by the operators."""
