"""Analytics over multi-entity road-segment time series, as lazy Spark DataFrame transformations.

``sources`` read and write, ``functions`` are scalar helpers, ``operators`` transform DataFrames,
``plans`` compose them into whole analyses, ``streaming`` feeds the store from a stream.
"""
