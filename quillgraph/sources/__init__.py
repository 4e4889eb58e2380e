"""Readers of raw documents, questions, answers and queues."""
