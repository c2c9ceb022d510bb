"""Set-at-a-time operators over class-graph tables."""
