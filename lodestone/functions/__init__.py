"""Scalar functions as Column expressions, with vectorised UDFs where no expression will do."""
