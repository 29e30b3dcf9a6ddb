"""Bloom, weather-station and scene-catalogue analytics as Spark DataFrames."""
