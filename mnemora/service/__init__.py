"""Facades: a store of tables on disk, and its commands over HTTP, MCP and the shell."""
