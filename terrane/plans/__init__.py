"""Stages that chain operators: partition, train, unlearn, and reports over their records."""
