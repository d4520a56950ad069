"""Many-against-many sequence similarity search on Spark."""
