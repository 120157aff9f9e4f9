"""Structured Streaming forms of the operators that see their input in parts."""
