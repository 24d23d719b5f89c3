"""Column-level building blocks; nothing here touches a DataFrame's rows in Python."""
