"""Graph query language: lexer, parser, binder to DataFrames, rewrites."""
