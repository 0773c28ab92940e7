"""Types and scalar functions."""
