"""The query language: tokens, statements, sessions and the shell."""
