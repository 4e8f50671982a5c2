"""Registered queries: one per operator, each over whole tables, with the SQL that checks it."""
