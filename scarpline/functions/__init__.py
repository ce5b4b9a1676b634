"""Column expressions shared by the operators; none of them uses a Python UDF."""
