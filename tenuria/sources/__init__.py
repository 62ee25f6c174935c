"""Readers, writers and the bronze / silver / gold table layers."""
