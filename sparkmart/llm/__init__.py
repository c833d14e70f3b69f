"""Operators for preparing training text: de-duplication, language, privacy, mixing, chat and tokens."""
