"""tenfold: a Spark-first analytics engine for histories of ten-slot contests."""
