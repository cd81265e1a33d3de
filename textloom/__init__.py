"""textloom: document preparation and text analytics as Spark DataFrame transforms."""
