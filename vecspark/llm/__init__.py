"""Operators of a training-data pipeline over `documents`-shaped tables; nothing else imports this package."""
