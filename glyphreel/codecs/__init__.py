"""Bitstream and pixel codecs in numpy; no Spark in here."""
