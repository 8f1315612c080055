"""Column functions: geometry, polygons, scores, rounding, labels. All stay inside the JVM."""
