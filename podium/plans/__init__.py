from .ordered import competition_rank, competition_ranks, exact_quantile, prefix_counts, row_rank
from .sizing import bounded_parts, broadcast_if_small, input_bytes, is_small, pin

__all__ = ["competition_rank", "competition_ranks", "exact_quantile", "prefix_counts", "row_rank",
           "bounded_parts", "broadcast_if_small", "input_bytes", "is_small", "pin"]
