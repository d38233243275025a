"""Readers and writers of the four on-disk formats, as Spark Python data sources."""
