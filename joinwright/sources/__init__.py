"""Readers, generators and writers of relations and tables."""
