"""Resumable and streaming processing."""
