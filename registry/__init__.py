"""Registered queries: each module pairs Spark queries with the SQL that must give the same rows."""
