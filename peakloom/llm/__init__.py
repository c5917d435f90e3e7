"""Training-data operators: one module an operator, plus the queries that apply them.

Nothing outside this folder imports it.
"""
