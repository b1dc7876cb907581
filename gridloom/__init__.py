"""gridloom: raster stacks, region graphs and distance profiles as Spark DataFrames.

An image is a relation, one row per pixel.  Every operator takes and returns DataFrames and
works on all images of the input in one job.
"""

__version__ = "0.1.0"
