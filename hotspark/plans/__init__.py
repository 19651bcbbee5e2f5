"""Registered queries, each with its SQL twin where one exists."""
