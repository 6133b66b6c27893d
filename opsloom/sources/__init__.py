"""Readers: files of many formats, audit logs, messages."""
