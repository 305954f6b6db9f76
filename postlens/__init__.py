"""postlens: social-post analytics as PySpark DataFrame operators."""
