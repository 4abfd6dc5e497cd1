"""Sources of files: whole files through Spark's reader, byte ranges through a Python data source."""
