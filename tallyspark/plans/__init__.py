"""The query surface and the declarative views behind it."""
