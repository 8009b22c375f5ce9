"""Requests as they are written, parsed into plans before any data is touched."""
