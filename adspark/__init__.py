"""An analytics engine for attribute-expression records on PySpark."""
