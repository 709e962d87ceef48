"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from loomery.llm import balls, fingerprints, infill, jaccard, language, lines, mixing, neighbours, pages, pieces, quality, sharding, unigram
from loomery.llm.common import small_batches
from loomery.session import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    docs = lambda s, d: table(small_batches(s), d, "documents")
    return {
        "op1_fingerprints": lambda s, d: fingerprints.op1_fingerprints(docs(s, d)),
        "op2_token_counts": lambda s, d: unigram.op2_token_counts(docs(s, d), vocabulary("piece_bpe_32k.model")),
        "op3_sharding": lambda s, d: sharding.op3_sharding(docs(s, d)),
        "op4_jaccard": lambda s, d: jaccard.op4_jaccard(docs(s, d)),
        "op5_quality": lambda s, d: quality.op5_quality(docs(s, d)),
        "op6_mixing": lambda s, d: mixing.op6_mixing(docs(s, d)),
        "op7_pages": lambda s, d: pages.op7_pages(table(small_batches(s), d, "pages")),
        "op8_lines": lambda s, d: lines.op8_lines(docs(s, d)),
        "op9_language": lambda s, d: language.op9_language(docs(s, d)),
        "op10_pieces": lambda s, d: pieces.op10_pieces(docs(s, d), vocabulary("piece_bpe_32k.model")),
        "op11_neighbours": lambda s, d: neighbours.op11_neighbours(table(small_batches(s), d, "embeddings")),
        "op12_infill": lambda s, d: infill.op12_infill(docs(s, d)),
        "op13_clusters": lambda s, d: balls.op13_clusters(table(small_batches(s), d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_jaccard": jaccard.OP4_SQL,
        "op8_lines": lines.OP8_SQL,
        "op11_neighbours": neighbours.OP11_SQL,
        "op12_infill": infill.OP12_SQL,
        "op13_clusters": balls.OP13_SQL,
    }
