"""Lexer and parser of JavaScript, TypeScript and their JSX forms, in plain Python for the workers."""

from knotwork.parser.grammar import GRAMMARS, extract, syntax_of, valid

__all__ = ["GRAMMARS", "extract", "syntax_of", "valid"]
