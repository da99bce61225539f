"""Operators for preparing training text at scale; nothing else in quorix imports this."""
