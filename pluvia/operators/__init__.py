"""DataFrame operators. Every function is lazy unless its docstring says it runs a job."""
