"""Assembly of the feature panel from bars, membership, sectors and a registry of factor sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X
from . import pit as P


@dataclass(frozen=True)
class FactorSource:
    """A table of dated values to be merged as of each panel date.

    ``load`` gives (ticker, date column, cols). With ``dropna`` rows that
    lack all cols go before the merge; otherwise a null row blanks what it
    follows. The merge adds the availability lag; sources stamp the date on
    which they are computed.
    """

    label: str
    load: Callable[[], DataFrame]
    cols: tuple[str, ...]
    date: str = "date"
    dropna: bool = True

    def __post_init__(self):
        if not self.cols:
            raise ValueError(f"{self.label} has no columns")


def ready(source: FactorSource, lag_days: int) -> tuple[DataFrame, str, list[str], int]:
    """The source's rows as an as-of merge takes them: one per ticker and date, whatever the input's order."""
    rows = source.load().select("ticker", F.col(source.date).alias("_on"), *source.cols)
    if source.dropna:
        rows = rows.dropna(how="all", subset=list(source.cols))
    return P.last_per(rows, ["ticker", "_on"], list(source.cols)), "_on", list(source.cols), lag_days


def build_panel(bars: DataFrame, sectors: DataFrame, sources: list[FactorSource], intervals: DataFrame | None = None, lag_days: int = 1, lag_controls: bool = False, horizon: int = 21) -> DataFrame:
    """Base features -> lagged controls -> membership mask -> sector -> rows with a target -> as-of merges (one exchange for all).

    Controls are shifted before the mask, so a name's first member day sees
    its own history.
    """
    rows = X.risk(X.momentum(X.forward_returns(bars, (horizon,))))
    controls = ["momentum_21d", "momentum_5d", "momentum_252_21", "volatility_21d", "volume_zscore", "log_dollar_volume"]
    if lag_controls:
        rows = X.lagged(rows, controls)
    if intervals is not None:
        rows = P.member_rows(rows, intervals)
    rows = rows.join(F.broadcast(sectors), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))
    rows = rows.where(F.col(f"fwd_{horizon}d").isNotNull())
    return P.asof_backward_many(rows, [ready(s, lag_days) for s in sources], "ticker", "date") if sources else rows
