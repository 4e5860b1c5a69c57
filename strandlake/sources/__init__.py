"""Readers and writers of the library's file formats."""
