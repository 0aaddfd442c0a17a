"""The expression language: syntax, values and the reference evaluator."""
