"""Readers and writers of alignment and annotation formats."""
