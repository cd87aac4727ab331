"""Readers and writers: JSON lines in their tolerance, datasets with manifests, benchmarks, knowledge bases."""
