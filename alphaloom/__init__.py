"""Cross-sectional factor research on daily panels, as DataFrame operators on Spark."""
