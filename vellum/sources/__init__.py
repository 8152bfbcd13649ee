"""Readers and writers for folders, label files, zone documents, matrices and configuration."""
