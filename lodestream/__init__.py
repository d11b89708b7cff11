"""lodestream: feature engineering and stream learning on time-ordered tables, as Spark jobs."""
