from quantframe.plans.halo import drop_halo, in_block, over_rows, with_halo
from quantframe.plans.intervals import join_ranges
from quantframe.plans.latest import keep_last
from quantframe.plans.layout import DEFAULT_LAYOUT, Layout, measure_layout
from quantframe.plans.ranks import average_ranks, ordered_counts
from quantframe.plans.scan import (
    index_rows, previous_row, running_max, running_product, running_sum)

__all__ = [
    "DEFAULT_LAYOUT", "Layout", "average_ranks", "drop_halo", "in_block", "index_rows",
    "join_ranges", "keep_last", "measure_layout", "ordered_counts", "over_rows", "previous_row", "running_max",
    "running_product", "running_sum", "with_halo",
]
