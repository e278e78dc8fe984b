"""Readers and writers of model, point-cloud and database formats."""
