"""Merge, recall, chain assembly, history and maintenance of agent memory."""
