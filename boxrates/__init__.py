"""boxrates: market-implied lending and borrowing rates from option quotes, on Spark.

Every operator is a plain function from DataFrame to DataFrame that treats all
chains of the input at once, so calls compose with ``df.transform``.
"""

from boxrates.operators.boxes import build_boxes, build_boxes_from_strikes, build_boxes_from_updates
from boxrates.operators.filters import view_filter
from boxrates.operators.views import (
    heatmap_matrix,
    lend_borrow,
    rate_curve,
    rate_heatmap,
    term_structure,
    top_opportunities,
)
from boxrates.params import RateParams
from boxrates.plans.collect import collect_snapshot
from boxrates.streaming.live import latest_boxes, stream_boxes

__all__ = [
    "RateParams",
    "build_boxes",
    "build_boxes_from_strikes",
    "build_boxes_from_updates",
    "collect_snapshot",
    "heatmap_matrix",
    "latest_boxes",
    "lend_borrow",
    "rate_curve",
    "rate_heatmap",
    "stream_boxes",
    "term_structure",
    "top_opportunities",
    "view_filter",
]
