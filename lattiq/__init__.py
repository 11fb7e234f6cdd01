"""Spark-native analytics of diffusion on spatial, multilayer graphs."""
