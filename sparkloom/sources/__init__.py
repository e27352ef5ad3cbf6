"""Readers and writers of genomics formats."""
