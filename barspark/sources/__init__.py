"""Readers and writers of bar tables."""
