"""Spark jobs over the logs of AI agents: conversations and run traces in, datasets and reports out."""
