"""Relational operators over runs, steps, extracted counts and evidence."""
