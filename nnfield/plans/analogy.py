"""Image analogy: A is to A' as B is to the image computed here, for a whole table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nnfield.operators.apply import gather, pair_blocks
from nnfield.operators.search import SearchOptions, bind_pairs, search_rounds


def analogy(pairs: DataFrame, pixels: DataFrame, options: SearchOptions, rounds: int,
            prime_column: str = "prime_img") -> DataFrame:
    """``(pair_id, h, w, y, x, v)``: the primed image seen through the field of every pair.

    The field lives on the grid of ``a_img`` and points into ``b_img``, whose primed version is read.
    """
    field = search_rounds(bind_pairs(pairs, pixels, options), options, rounds)
    return gather(field, pair_blocks(pairs, pixels, prime_column), pairs=pairs)
