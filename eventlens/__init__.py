"""Event-log analytics and text preparation as Spark jobs."""
