"""Bulk page and text intake on Spark: extraction, cleaning, identity, diff, library queries and exports."""
