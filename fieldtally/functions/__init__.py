"""Column-level building blocks. Everything here stays inside Catalyst expressions."""
