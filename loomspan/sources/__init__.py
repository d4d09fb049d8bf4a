"""Part of loomspan: sources."""
