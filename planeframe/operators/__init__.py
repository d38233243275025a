"""Operators over frames: validation, admission, gap fill, summaries, tiling."""
