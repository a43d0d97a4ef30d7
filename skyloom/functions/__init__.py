"""Part of skyloom."""
