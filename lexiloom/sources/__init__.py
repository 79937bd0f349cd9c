"""Readers: bytes of one file into blocks or rows."""
