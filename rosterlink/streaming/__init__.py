"""The stateless steps over a streaming input."""
