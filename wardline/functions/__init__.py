"""Column functions, all of them Spark built-ins that stay in the JVM.

Operands are given as SQL text, a column name in most cases. One parsed
expression is one call to the JVM, where the same tree built operator by
operator is dozens, and plans here have hundreds of nodes.
"""
