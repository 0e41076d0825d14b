"""Operators for preparing training text: encoding, scoring, fingerprints, filters, mixing."""
