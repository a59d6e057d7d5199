"""Part of tenfold: sources."""
