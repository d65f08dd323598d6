"""Column helpers with this library's rules for null and NaN."""
