"""Column functions: plain expressions over columns, all of them inside Spark's own code generation or its array functions."""
