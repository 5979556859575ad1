"""The registered queries, the tables they derive and the SQL they are checked against."""
