"""Structured Streaming: log tails, sessions, stop rules, poll-and-score, upserts."""
