"""Part of loomspan: sinks."""
