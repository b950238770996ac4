"""Readers and writers for the engine's file formats."""
