"""Part of loomspan: streaming."""
