"""Stateful operators, as batch folds and as streams."""
