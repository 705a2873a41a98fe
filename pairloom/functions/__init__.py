"""Column builders: per-pixel expressions and predicates. All stay inside whole-stage code."""
