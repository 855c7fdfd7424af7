"""Source-code and text-corpus analytics as Spark jobs."""
