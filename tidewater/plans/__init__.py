"""From SQL text to DataFrames: lexer, syntax tree, parser, binder."""
