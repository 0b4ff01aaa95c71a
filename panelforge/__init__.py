"""panelforge: a Spark-first engine for panel data, similarity graphs and reports."""
