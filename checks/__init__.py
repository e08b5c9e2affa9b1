"""The registered queries and the SQL that their results are compared with."""
