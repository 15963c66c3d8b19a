"""Nearest-neighbour fields over tables of pixels, written with the PySpark DataFrame API."""
