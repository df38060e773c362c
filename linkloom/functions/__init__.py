"""Scalar functions: URL decomposition in Column form and the codecs."""
