"""The stateless page jobs on streams."""
