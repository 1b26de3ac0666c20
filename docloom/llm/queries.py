"""All queries of this subpackage, with SQL where SQL can express them."""

from importlib import import_module

NAMES = ["search", "lines", "quality", "langid", "packing", "bpe", "toxicity", "suffix", "simhash", "urls", "tokencounts", "trie", "divergence"]
_MODULES = [import_module(f"{__package__}.{n}") for n in NAMES]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
