"""Thin ways in: JSON routes, tools over JSON-RPC, a command line, and their configuration."""
