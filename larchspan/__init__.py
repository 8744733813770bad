"""Disturbance analytics over long tables of dated observations, on Spark."""
