"""Operators of a training-data pipeline over a corpus table `documents`.

Nothing else in the library imports this package.  `queries()` and
`oracle_sql()` of `changelens.llm.catalog` list what it registers.
"""
