"""Relational operators over the access log: tables, sessions, statistics, geography, reports."""
