"""What to compare: the clients, the two methods and the evaluated window."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the input table.
COMPARABLE = "COMPARABLE"
TIE = "TIE"
# Label of the row that covers every client.
TOTAL = "TOTAL"


@dataclass(frozen=True)
class Settings:
    """Parameters of one comparison.

    ``clients`` lists the clients to analyse, in report order; ``None`` takes every
    row, and rows without a client form a client of their own. ``base`` and ``challenger`` are the two method names and, with
    ``months``, pick the input columns (``SCP_WAPE_6M`` ...). ``approx`` replaces exact
    percentiles by ``percentile_approx``. ``sum_scale`` sums volumes as decimals with that
    many places, so that the result does not depend on the order of addition.
    ``null_label`` is the text shown for a missing reason, model or class.
    """

    clients: tuple[int, ...] | None = None
    batches: tuple[int, ...] | None = None
    base: str = "SCP"
    challenger: str = "ML"
    months: int = 6
    top_n: int = 20
    approx: bool = False
    sum_scale: int | None = None
    null_label: str | None = None

    def __post_init__(self):
        for name in ("clients", "batches"):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, tuple(dict.fromkeys(value)))

    # -- column names ---------------------------------------------------------

    @property
    def horizon(self) -> str:
        return f"{self.months}M"

    def wape(self, method: str) -> str:
        return f"{method}_WAPE_{self.horizon}"

    def abs_error(self, method: str) -> str:
        return f"{method}_TOTAL_ABS_ERROR_{self.horizon}"

    def forecasts(self, method: str) -> list[str]:
        return [f"{method}_FORECAST_M{i}" for i in range(1, self.months + 1)]

    def best_model(self, method: str) -> str:
        return f"{method}_BEST_MODEL"

    @property
    def history(self) -> list[str]:
        return [f"HISTORY_M{i}" for i in range(1, self.months + 1)]

    @property
    def total_history(self) -> str:
        return f"TOTAL_HISTORY_{self.horizon}"

    @property
    def winner(self) -> str:
        return f"WINNER_METHOD_{self.horizon}"

    @property
    def winner_model(self) -> str:
        return f"WINNER_MODEL_{self.horizon}"

    @property
    def finalist(self) -> str:
        return f"FINALIST_METHOD_{self.horizon}"

    @property
    def finalist_model(self) -> str:
        return f"FINALIST_MODEL_{self.horizon}"

    @property
    def winner_improvement(self) -> str:
        return f"WINNER_IMPROVEMENT_PCT_{self.horizon}"

    @property
    def improvement(self) -> str:
        return f"{self.challenger}_IMPROVEMENT_VS_{self.base}_{self.horizon}"

    @property
    def excluded_flag(self) -> str:
        return f"HAS_{self.challenger}_EXCLUDED"

    @property
    def exclusion_reason(self) -> str:
        return f"{self.challenger}_EXCLUSION_REASON"

    @property
    def no_output_reason(self) -> str:
        return f"{self.base}_NO_OUTPUT_REASON"

    @property
    def series_dimensions(self) -> list[str]:
        return [
            f"{self.challenger}_CLASSIFICATION",
            f"{self.challenger}_TYPE",
            "SERIES_CLASSIFICATION",
        ]

    # -- status codes ---------------------------------------------------------

    @property
    def status_excluded(self) -> str:
        return f"NOT_COMPARABLE_{self.challenger}_EXCLUDED"

    @property
    def status_missing_both(self) -> str:
        return f"NOT_COMPARABLE_MISSING_{self.base}_AND_{self.challenger}"

    def status_missing(self, method: str) -> str:
        return f"NOT_COMPARABLE_MISSING_{method}"

    # -- labels ---------------------------------------------------------------

    @property
    def labels(self) -> list[str] | None:
        """TOTAL and the configured clients, in report order."""
        if self.clients is None:
            return None
        return [TOTAL, *(str(c) for c in self.clients)]
