"""Site-suitability analytics as Spark DataFrame transforms.

Every public function takes and returns DataFrames or Columns, so the same
definition runs on one row, on a table of billions of sites, or on a stream.
"""
