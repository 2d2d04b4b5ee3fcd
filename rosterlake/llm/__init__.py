"""Operators for preparing language-model training data with Spark.

Nothing outside this subpackage imports it.  `queries.QUERIES` and
`queries.ORACLE_SQL` hold the registered queries.
"""
