"""Reading schemas and tables from Parquet, catalogs, JDBC and samples."""
