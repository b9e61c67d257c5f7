"""Sensitive-data detection and redaction over corpora, as DataFrame-to-DataFrame functions."""
