"""usageloom: usage-log and quota analytics on PySpark DataFrames."""
