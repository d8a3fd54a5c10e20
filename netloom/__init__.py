"""netloom: connectivity-graph analytics over tables of drawing primitives, expressed as Spark plans."""
