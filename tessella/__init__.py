"""Customer-audience analytics expressed as Spark plans.

Every operator takes DataFrames or Columns and returns DataFrames or Columns;
nothing here collects its input to the driver.
"""
