"""Landed-file readers."""
