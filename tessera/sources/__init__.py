"""Readers: CSV with inference, folders of media and text, rows."""
