"""roadloom: road-traffic data operators and text-corpus operators as Spark jobs."""
