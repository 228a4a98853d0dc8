"""Market screening expressed as Spark DataFrame jobs.

Every operator takes DataFrames plus parameters and returns a DataFrame; nothing
here collects data to the driver.  "Now" is always an explicit ``asof`` value.
"""
