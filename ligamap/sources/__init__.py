"""Where assemblies come from: datasets of Parquet tables, AGP text, directories, and tables derived for tests."""
