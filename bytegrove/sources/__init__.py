"""Readers: driver tables, directories and archives of class files."""
