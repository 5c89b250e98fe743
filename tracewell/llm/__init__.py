"""Operators for preparing training corpora: packing, deduplication, archives, tokens, scoring.

Nothing outside this subpackage imports it.  Each module keeps a general
operator (any column names, real outputs) and ``queries`` derives the digest
tables from them.
"""
