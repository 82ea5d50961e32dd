"""Readers of posting payloads, lists, trees of manifests and tables, and the writers that go with them."""
