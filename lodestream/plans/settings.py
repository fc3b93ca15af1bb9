"""Typed settings with defaults, dotted access and environment substitution."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from dataclasses import dataclass, field


@dataclass
class Cleaning:
    max_gap_seconds: float = 60.0
    price_z: float = 5.0
    volume_iqr: float = 3.0


@dataclass
class Features:
    minimal: bool = False
    technical: bool = True
    smart_money: bool = True
    profile_lookbacks: tuple[int, ...] = (50, 100, 200)
    profile_bins: int = 50
    value_area: float = 0.7


@dataclass
class Risk:
    per_trade: float = 0.02
    daily_loss: float = 0.02
    max_positions: int = 3
    max_trades_per_day: int = 50
    drawdown_levels: tuple[float, ...] = (0.03, 0.04, 0.05)


@dataclass
class Settings:
    cleaning: Cleaning = field(default_factory=Cleaning)
    features: Features = field(default_factory=Features)
    risk: Risk = field(default_factory=Risk)

    def get(self, path: str, default=None):
        at = self
        for name in path.split("."):
            if not hasattr(at, name):
                return default
            at = getattr(at, name)
        return at

    def set(self, path: str, value) -> None:
        *parents, last = path.split(".")
        at = self.get(".".join(parents)) if parents else self
        if at is None or last not in {f.name for f in dataclasses.fields(at)}:
            raise KeyError(path)
        setattr(at, last, value)

    def update(self, values: dict) -> Settings:
        """values: nested, as a settings document holds them."""
        for name, part in values.items():
            for key, value in part.items():
                self.set(f"{name}.{key}", value)
        return self

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)

    def export(self, path: str) -> None:
        """As a JSON document, which load reads again."""
        with open(path, "w") as f:
            json.dump(self.as_dict(), f, indent=2, sort_keys=True)

    @classmethod
    def load(cls, path: str, env: dict[str, str] | None = None) -> Settings:
        """Defaults, overridden by a JSON document with environment names in it; checked."""
        with open(path) as f:
            out = cls().update(json.loads(substitute(f.read(), env)))
        if wrong := out.problems():
            raise ValueError("; ".join(wrong))
        return out

    def problems(self) -> list[str]:
        """What is out of range, by path."""
        shares = ("features.value_area", "risk.per_trade", "risk.daily_loss")
        wrong = [f"{p} must lie between 0 and 1" for p in shares if not 0 < self.get(p) <= 1]
        above = ("cleaning.max_gap_seconds", "cleaning.price_z", "cleaning.volume_iqr", "features.profile_bins", "risk.max_positions", "risk.max_trades_per_day")
        wrong += [f"{p} must be above 0" for p in above if self.get(p) <= 0]
        levels = list(self.risk.drawdown_levels)
        return wrong + (["risk.drawdown_levels must rise"] if levels != sorted(levels) else [])


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:default} from the environment; a name that is not set and has no default stays."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), text)
