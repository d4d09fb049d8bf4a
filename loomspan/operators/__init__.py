"""Part of loomspan: operators."""
