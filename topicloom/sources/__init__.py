"""Readers and writers for rows, topics, sessions, models and vector indexes."""
