"""Parameters of the trading rules and the indicator set."""

from __future__ import annotations

from dataclasses import dataclass

#: Minutes of an open day's grid: 04:00 to 17:00, both ends included.
GRID_MINUTES = 781
OPEN_MINUTE, CLOSE_MINUTE = 4 * 60, 17 * 60
MARKET_ZONE = "America/Los_Angeles"
#: Rows back of the minute lags, by feature name.
LAGS = {"close1min": 1, "close2min": 2, "close5min": 5, "close10min": 10, "close30min": 30, "close1hr": 60}
MEAN_PERIODS = (5, 10, 20, 50)
#: Bollinger: period and width in standard deviations.
BOLLINGER = {20: 2.0, 50: 2.1}
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
RSI_PERIOD = STOCHASTIC_PERIOD = 14
CATEGORIES = 8
SELL_LABELS = ("Weak Sell", "Sell", "Strong Sell")


@dataclass(frozen=True)
class Trading:
    available: float = 300.0
    min_purchase: float = 100.0
    max_purchase: float = 10_000.0
    transactions: int = 10
    predict_days: int = 2
    cancel_minutes: int = 10

    def cost(self, total: float) -> float:
        """What one purchase may cost."""
        return max(self.min_purchase, min(self.max_purchase, total / self.transactions))

    def number_of_buys(self, total: float) -> int:
        cost = self.cost(total)
        return int(self.available // cost) if self.available > cost else 0
