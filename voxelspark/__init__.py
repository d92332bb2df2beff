"""Volumetric sensor data as Spark tables: Morton-keyed voxel maps, fusion and spatial queries."""
