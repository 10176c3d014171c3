"""Settings of the demand engine in one place."""

import datetime
from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Windows, grids and flags. Every operator takes what it needs as arguments; these are the defaults."""

    sum_days: tuple[int, ...] = (7, 14, 28, 56, 90)
    std_days: tuple[int, ...] = (28, 56)
    active_days: tuple[int, ...] = (28, 56, 90)
    revenue_days: tuple[int, ...] = (7, 28, 90)
    price_days: tuple[int, ...] = (28, 90)
    entity_days: tuple[int, ...] = (7, 28, 90)
    engagement_days: tuple[int, ...] = (1, 3, 7, 14, 28)
    view_event: str = "view_item"
    cart_event: str = "add_to_cart"
    epsilon: float = 1e-6
    horizon_days: int = 31
    clip_multiplier: float = 2.0
    floor: float = 0.5
    alpha_steps: int = 21
    scale_step: float = 0.05
    random_seed: int = 42
    zero_weight: float = 1.0
    calendar_features: bool = False
    event_features: bool = False
    fold_years: bool = False
    #: Dates of the lunar new year.
    new_years: tuple[datetime.date, ...] = field(default=(
        datetime.date(1998, 1, 28), datetime.date(1999, 2, 16), datetime.date(2000, 2, 5),
        datetime.date(2025, 1, 29), datetime.date(2026, 2, 17), datetime.date(2027, 2, 6),
    ))


DEFAULTS = EngineConfig()
