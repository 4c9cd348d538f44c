"""Operations of a training-data pipeline, each one a function on DataFrames.

Nothing else in the library imports this subpackage.
"""
