"""Readers of conversations, traces, artifacts, rules and tasks, and the dataset writer."""
