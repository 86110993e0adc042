"""Relational operators over the graph and the decision store."""
