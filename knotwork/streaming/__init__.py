"""Streaming forms of the session state machine."""
