"""Operators for training corpora: quality, near copies, leaks, languages, formats, archives, licences, tokens, URLs."""
