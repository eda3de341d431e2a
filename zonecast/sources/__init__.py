"""Readers, writers, mart schemas and the record adapter."""
