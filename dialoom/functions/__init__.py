"""Part of dialoom."""
