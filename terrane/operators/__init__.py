"""Relational operators over ``nodes``, ``edges``, ``membership`` and mapped tables."""
