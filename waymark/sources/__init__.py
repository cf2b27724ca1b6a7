"""Readers and writers of recordings, layers, annotated tables and manifests."""
