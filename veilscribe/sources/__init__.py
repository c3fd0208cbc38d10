"""Readers and writers of the files that the stages exchange."""
