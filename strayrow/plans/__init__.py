"""Whole analyses put together from operators, and the queries that check them."""
