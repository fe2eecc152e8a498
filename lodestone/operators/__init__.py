"""Statements that change collections."""
