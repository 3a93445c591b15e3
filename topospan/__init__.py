"""topospan: analytics over sampled and spline-modelled fields, written as Spark plans."""
