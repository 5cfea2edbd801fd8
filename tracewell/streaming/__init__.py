"""Continuous capture: run assembly, token attachment, live flags."""
