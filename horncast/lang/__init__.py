"""The theory language: lexer, syntax tree, parser, diagnostics."""
