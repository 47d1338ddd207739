"""fieldloom: validated field tables out of large document collections, on Spark."""
