"""Record, interval, text, graph and data-quality analytics as Spark DataFrame operators."""
