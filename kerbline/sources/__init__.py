"""Readers, writers and the small tables that ship with the library."""
