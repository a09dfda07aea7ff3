"""All registered queries; importing this module registers them."""

from . import (  # noqa: F401
    q_labels,
    q_learning,
    q_payments,
    q_relational,
    q_rolling,
    q_scalars,
    q_spine,
    q_streaming,
)
from .registry import ORACLES, QUERIES  # noqa: F401
