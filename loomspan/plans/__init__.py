"""Part of loomspan: plans."""
