"""Source parsers: chunks, symbols and edges of a file, by language. None of them raises on malformed input."""

from .registry import EXTENSIONS, LANGUAGES, Parsed, load_extra, parse, parse_files

__all__ = ["EXTENSIONS", "LANGUAGES", "Parsed", "load_extra", "parse", "parse_files"]
