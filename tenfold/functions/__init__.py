"""Part of tenfold: functions."""
