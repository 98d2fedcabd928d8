"""The driver's tables in the roles of the retail tables, queries and their SQL."""
