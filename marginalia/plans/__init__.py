"""The catalogue of queries over the input tables, and the SQL that each is checked against."""
