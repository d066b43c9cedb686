"""Names, thresholds and word lists: everything that configures the operators.

A panel has one row per (entity, date). The operators are generic; the heat
application is the configuration ``HEAT`` below.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LabelRule:
    """Absolute-threshold qualifying rule, one pair of thresholds per zone."""

    plains_value: float = 40.0
    departure: float = 4.5
    override: float = 45.0
    coastal_value: float = 37.0
    min_run: int = 2


@dataclass(frozen=True)
class RelativeRule:
    """Percentile-based qualifying rule, active in some months only."""

    floor: float = 30.0
    first_month: int = 5
    last_month: int = 9
    quantile: float = 0.9
    min_run: int = 3


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity"
    date: str = "date"
    value: str = "v"
    alias: str = "v"                      # prefix of the trend columns
    variables: tuple[str, ...] = ("v",)   # columns that get lags and rolling stats
    current: tuple[str, ...] = ("v",)     # same-day columns of the feature contract
    normal: str = "normal"
    departure: str = "departure"
    qualifying: str = "qualifying"
    label: str = "label"
    target: str = "target"
    lags: tuple[int, ...] = (1, 2, 3, 7)
    rolls: tuple[int, ...] = (3, 7)
    slopes: tuple[int, ...] = (3, 7)
    z_window: int = 30
    z_min: int = 10
    coastal_types: tuple[str, ...] = ("coastal",)
    rule: LabelRule = LabelRule()
    relative: RelativeRule = RelativeRule()

    def look_back(self) -> int:
        """Rows before a row that its features can see."""
        return 1 + max(*self.lags, *self.rolls, *self.slopes, self.z_window, 7)

    def lag_names(self) -> list[str]:
        names = [f"{v}_lag{k}" for v in self.variables for k in self.lags]
        names += [f"{self.departure}_lag{k}" for k in self.lags]
        return names + [f"{self.label}_lag1"]

    def roll_names(self) -> list[str]:
        return [f"{v}_roll{w}_{s}" for v in self.variables for w in self.rolls for s in ("mean", "max", "min")]

    def trend_names(self) -> list[str]:
        return [f"{self.alias}_delta_{k}d" for k in (1, 3, 7)] + [f"{self.alias}_slope_{w}d" for w in self.slopes]

    def calendar_names(self) -> list[str]:
        return ["month", "day_of_year", "season_code", "month_sin", "month_cos", "doy_sin", "doy_cos"]

    def entity_names(self) -> list[str]:
        return ["entity_code", "is_coastal", "latitude", "longitude"]

    def baseline_contract(self) -> list[str]:
        """Same-day, calendar and entity columns only."""
        return sorted([*self.current, self.normal, self.departure, self.qualifying,
                       *self.calendar_names(), *self.entity_names()])

    def contract(self) -> list[str]:
        """All model inputs in contract order (alphabetical)."""
        return sorted([*self.baseline_contract(), *self.lag_names(), *self.roll_names(),
                       *self.trend_names(), f"{self.departure}_zscore"])


# The application's column names.
WEATHER = (
    "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
    "apparent_temperature_max", "apparent_temperature_min", "apparent_temperature_mean",
    "precipitation_sum", "wind_speed_10m_max", "wind_gusts_10m_max",
    "relative_humidity_2m_max", "relative_humidity_2m_min", "relative_humidity_2m_mean",
    "surface_pressure_mean", "shortwave_radiation_sum", "et0_fao_evapotranspiration",
)
KEY_WEATHER = (
    "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean",
    "relative_humidity_2m_mean", "precipitation_sum", "wind_speed_10m_max", "surface_pressure_mean",
)
HEAT = PanelSpec(
    entity="city_key", value="temperature_2m_max", alias="tmax", variables=KEY_WEATHER, current=WEATHER,
    normal="tmax_normal", departure="tmax_departure", qualifying="qualifying_day", label="heatwave",
    target="heatwave_next_day",
)

# Hard physical limits of the stored panel (lower, upper).
PHYSICAL_BOUNDS = {
    "temperature_2m_max": (-20.0, 60.0),
    "temperature_2m_min": (-20.0, 50.0),
    "temperature_2m_mean": (-20.0, 55.0),
    "apparent_temperature_max": (-30.0, 70.0),
    "apparent_temperature_min": (-30.0, 60.0),
    "apparent_temperature_mean": (-30.0, 65.0),
    "precipitation_sum": (0.0, 600.0),
    "rain_sum": (0.0, 600.0),
    "wind_speed_10m_max": (0.0, 200.0),
    "wind_gusts_10m_max": (0.0, 300.0),
    "relative_humidity_2m_max": (0.0, 100.0),
    "relative_humidity_2m_min": (0.0, 100.0),
    "relative_humidity_2m_mean": (0.0, 100.0),
    "surface_pressure_mean": (800.0, 1100.0),
    "shortwave_radiation_sum": (0.0, 50.0),
    "et0_fao_evapotranspiration": (0.0, 20.0),
}

# Softer limits of one submitted record; a breach only warns.
SANITY_BOUNDS = {
    "temperature_2m_max": (-5.0, 55.0),
    "temperature_2m_mean": (-5.0, 50.0),
    "temperature_2m_min": (-10.0, 45.0),
    "apparent_temperature_max": (-10.0, 65.0),
    "apparent_temperature_mean": (-10.0, 60.0),
    "apparent_temperature_min": (-15.0, 55.0),
    "precipitation_sum": (0.0, 500.0),
    "relative_humidity_2m_max": (0.0, 100.0),
    "relative_humidity_2m_mean": (0.0, 100.0),
    "relative_humidity_2m_min": (0.0, 100.0),
    "surface_pressure_mean": (900.0, 1050.0),
    "wind_speed_10m_max": (0.0, 200.0),
    "wind_gusts_10m_max": (0.0, 300.0),
    "shortwave_radiation_sum": (0.0, 40.0),
    "et0_fao_evapotranspiration": (0.0, 20.0),
    "tmax_departure": (-20.0, 25.0),
    "tmax_departure_zscore": (-10.0, 10.0),
    "tmax_normal": (10.0, 50.0),
}
# Names, columns and years that input tables use.
ENTITY_ALIASES = {
    "delhi": "delhi", "lucknow": "lucknow", "nagpur": "nagpur", "ahmedabad": "ahmedabad", "mumbai": "mumbai",
    "new delhi": "delhi", "new_delhi": "delhi",
}
PASSTHROUGH = (
    "city", "city_key", "date", "state", "region_type", "heatwave_next_day",
    "actual_heatwave_next_day", "prediction_probability", "prediction_label",
)
YEAR_RANGE = (1990, 2030)

# Risk levels with their lower probability bound.
RISK_LEVELS = (("LOW", 0.0), ("MODERATE", 0.3), ("HIGH", 0.6), ("EXTREME", 0.8))
RISK_RANK = {"LOW": 0, "MODERATE": 1, "HIGH": 2, "EXTREME": 3}
DECISION_THRESHOLD = 0.70

# Drift screening.
PSI_LEVELS = ((0.10, "stable"), (0.20, "monitor"), (0.25, "drift_detected"))
PSI_FLOOR = 1e-6
PSI_OUTER = 1e308
PSI_MIN_ROWS = 30

# Forecast alerts.
QUIET_FROM, QUIET_UNTIL = 22, 6
DAILY_CAP = 2
ALERT_ZONE = "Asia/Kolkata"
