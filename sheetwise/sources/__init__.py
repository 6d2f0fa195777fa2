"""Readers and writers of packages, records, page markup and ledgers."""
