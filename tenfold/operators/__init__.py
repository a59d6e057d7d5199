"""Part of tenfold: operators."""
