"""Panel, feature, split, model, scoring, ranking and comparison operators."""
