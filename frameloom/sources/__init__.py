"""Readers and writers for requests, objects, archives, manifests and results."""
