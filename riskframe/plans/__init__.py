"""End-to-end compositions and the registered queries."""
