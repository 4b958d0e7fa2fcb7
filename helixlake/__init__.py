"""helixlake: DNA data-storage analytics expressed as lazy Spark DataFrame programs."""
