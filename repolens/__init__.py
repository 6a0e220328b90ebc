"""Analytics over the contents of software repositories, on PySpark DataFrames."""
