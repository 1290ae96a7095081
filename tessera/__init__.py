"""Template and text corpus analytics on Spark."""
