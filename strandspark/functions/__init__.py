"""Column functions: CIGAR strings, flags, tags, sequences, qualities and statistics."""
