"""Bitmap-caption analytics on Spark."""
