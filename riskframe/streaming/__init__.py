"""Structured Streaming forms of the rolling features and rules."""
