"""Column functions: every one is a Catalyst expression unless its docstring says otherwise."""
