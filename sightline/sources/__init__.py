"""Readers and payload jobs that turn stored source payloads into typed tables."""
