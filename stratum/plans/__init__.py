"""Operation plans: their text, shape and meaning."""
