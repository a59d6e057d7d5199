"""Part of tenfold: streaming."""
