"""Part of loomspan: functions."""
