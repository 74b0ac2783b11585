"""Operators of a large training-data pipeline; nothing else imports this package."""
