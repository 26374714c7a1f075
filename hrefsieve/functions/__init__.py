"""Column functions: text, URLs, percent-encoding, and the Arrow helpers."""
