"""Readers and writers for the catalogue's file formats."""
