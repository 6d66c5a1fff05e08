"""orrery: a Spark-first engine for code-knowledge graphs and document corpora."""
