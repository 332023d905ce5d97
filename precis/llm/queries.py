"""Registers every query of this package."""


import corpus_pipeline
from precis.plans import registry


def load_all() -> None:
    from precis.llm import (  # noqa: F401
        chat,
        codes,
        language,
        maxent,
        mixing,
        near,
        neighbours,
        packing,
        passages,
        quality,
        toxicity,
        trie,
        warc,
    )
    if "pipeline" not in registry.QUERIES:
        registry.register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
