"""Tessera: a PySpark-native analytics library for tiled multi-band scenes."""
