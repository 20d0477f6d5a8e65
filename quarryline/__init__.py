"""Analytics over the text a software team keeps in version control, on PySpark."""
