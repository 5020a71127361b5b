"""Relational operators over task, prediction and result tables."""
