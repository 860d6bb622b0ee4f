"""A decoder of PDF files in pure Python; nothing in it knows of Spark."""
