"""Battery parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Battery:
    """Storage unit. Losses occur on charging only; the daily discharge cap is the
    capacity, as in the published runs (``e_cycle_24h`` is carried, not applied)."""

    delta_t: float = 0.25
    eta_chg: float = 0.95
    p_max_mw: float = 25.0
    e_max_mwh: float = 200.0
    e_cycle_24h: float = 200.0
    initial_soc_frac: float = 0.5

    def __post_init__(self) -> None:
        if not 0 < self.eta_chg <= 1:
            raise ValueError("eta_chg must be in (0, 1]")
        if min(self.delta_t, self.p_max_mw, self.e_max_mwh, self.e_cycle_24h) <= 0:
            raise ValueError("delta_t, p_max_mw, e_max_mwh and e_cycle_24h must be positive")
        if not 0 <= self.initial_soc_frac <= 1:
            raise ValueError("initial_soc_frac must be in [0, 1]")

    @property
    def charge_step(self) -> float:
        """Energy stored by one interval at full charging power."""
        return self.eta_chg * self.p_max_mw * self.delta_t

    @property
    def discharge_step(self) -> float:
        """Energy delivered by one interval at full discharging power."""
        return self.p_max_mw * self.delta_t

    @property
    def start_soc(self) -> float:
        return self.e_max_mwh * self.initial_soc_frac
