"""Readers and writers for object, image, model and heatmap tables."""
