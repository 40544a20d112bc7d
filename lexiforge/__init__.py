"""lexiforge: keyword-in-context and corpus analytics as Spark DataFrame operators."""
