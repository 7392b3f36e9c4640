"""Training-data pipeline operators: ten self-contained Spark jobs.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
``opN_*`` queries and ``oracle.py`` the SQL they are compared with.
"""
