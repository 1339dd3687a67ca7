"""Readers and writers that turn files into long tables and back."""
