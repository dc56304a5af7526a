"""Code-intelligence analytics on Spark: an index of sources, and questions that are answered as DataFrames."""

from quillmesh.functions.registration import register
from quillmesh.functions.thesaurus import thesaurus
from quillmesh.operators.markov import CHAIN_WEIGHTS, build_chains, walk
from quillmesh.sources.ingest import Parsers, parse_files, relations, scan
from quillmesh.sources.store import Store, find_config
from quillmesh.tools import Tools

__all__ = ["CHAIN_WEIGHTS", "Parsers", "Store", "Tools", "build_chains", "find_config", "parse_files", "register", "relations", "scan", "thesaurus", "walk"]
