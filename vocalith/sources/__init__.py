"""Readers and writers of manifests, logs, catalogues, reports and media."""
