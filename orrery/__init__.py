"""Particle, lattice and tree analytics on Spark DataFrames."""
