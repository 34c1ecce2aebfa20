"""Spark-native analytics over sparse voxel grids, dense label volumes and triangle meshes."""

__version__ = "0.1.0"
