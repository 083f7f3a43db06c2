"""Recognition of sheets by a web service."""
