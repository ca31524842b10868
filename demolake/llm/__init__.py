"""Training-data operators on Spark: one module per operator, plus shared helpers.

Nothing outside this subpackage imports it; its queries are registered in
``demolake.llm.queries``.
"""
