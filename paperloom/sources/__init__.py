"""Readers and writers of batches, sidecars, password lists and results."""
