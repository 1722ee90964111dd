"""Column helpers and small numeric routines."""
