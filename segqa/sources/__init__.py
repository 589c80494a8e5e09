"""Readers and table stores."""
