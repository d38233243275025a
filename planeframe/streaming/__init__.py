"""Live append: micro-batches of frames into a dataset."""
