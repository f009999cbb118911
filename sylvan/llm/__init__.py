"""Operators for preparing training text: quality, decontamination, tokens, duplicates, personal data, pages, URLs, licences."""
