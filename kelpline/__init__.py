"""Analytics over file listings, search results, activity and text, as PySpark DataFrame functions."""
