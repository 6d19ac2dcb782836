"""Queries over the test tables, by group; each module fills the registry with a query and the SQL it is held against."""
