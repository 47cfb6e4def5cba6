"""Readers and writers of experiment settings, BEIR folders, cell results, caches and labels."""
