"""From expressions to Spark columns."""
