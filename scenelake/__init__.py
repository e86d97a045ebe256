"""Scene-event analytics as Spark jobs: batch and streaming, many cameras in one plan."""
