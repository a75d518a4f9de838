"""Trailmill: Spark-native processing of recorded user-interface trajectories."""
