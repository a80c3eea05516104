"""panelforge: cross-sectional factor research on PySpark DataFrames."""
