"""Operators on fields, connectivity, fragments and meshes: DataFrames in, DataFrames out, no action of their own."""
