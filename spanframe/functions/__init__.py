"""Column functions: clocks, text, fingerprints. All JVM-side."""
