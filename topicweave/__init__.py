"""Graph-based topic mining over labelled text corpora, as Spark jobs."""
