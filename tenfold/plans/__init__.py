"""Part of tenfold: plans."""
