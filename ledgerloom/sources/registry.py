"""Client and calendar configuration: small YAML, checked on the driver, then tables to join."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession

# Fixed values.
DOMAINS = ("TRADE", "POSITION", "CASH", "COLLATERAL")
CADENCES = ("DAILY", "WEEKLY", "MONTHLY")
DEFAULT_WINDOW = 2
CLIENT_KEYS = {"client_id", "client_name", "calendar", "late_window_days", "accounts", "filename_patterns", "expectations", "overrides", "value_date_hints"}
CALENDAR_KEYS = {"calendar_id", "holidays", "weekend", "description"}


class ConfigError(ValueError):
    """A configuration that must not be used."""


@dataclass(frozen=True)
class Registry:
    clients: tuple[dict, ...]
    calendars: tuple[dict, ...]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """accounts, patterns, expectations and clients as DataFrames (bounded by the configuration)."""
        accounts = [(a["account_id"], c["client_id"], a.get("name")) for c in self.clients for a in c.get("accounts", [])]
        patterns = [
            (c["client_id"], i, java_pattern(p["pattern"]), p.get("domain"), p.get("source"))
            for c in self.clients
            for i, p in enumerate(c.get("filename_patterns", []))
        ]
        expected = [(c["client_id"], e["domain"], e.get("cadence", "DAILY"), e.get("cuts_per_day", 1)) for c in self.clients for e in c.get("expectations", [])]
        clients = [(c["client_id"], c.get("client_name"), c["calendar"], c.get("late_window_days") or DEFAULT_WINDOW) for c in self.clients]
        make = spark.createDataFrame
        return {
            "accounts": make(accounts, "account_id string, client_id string, account_name string"),
            "patterns": make(patterns, "client_id string, hint_no int, pattern string, domain string, source string"),
            "expectations": make(expected, "client_id string, domain string, cadence string, cuts_per_day int"),
            "clients": make(clients, "client_id string, client_name string, calendar_id string, window int"),
        }

    def holidays(self) -> dict[str, list[tuple[str, str]]]:
        return {c["calendar_id"]: [(str(h["date"]), h.get("name", "")) for h in c.get("holidays", [])] for c in self.calendars}


def java_pattern(pattern: str) -> str:
    """A pattern with named groups as Java writes them."""
    return re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


def load(clients: Iterable[str], calendars: Iterable[str]) -> Registry:
    """The registry of YAML texts; unknown keys, bad patterns, domains, cadences or calendars, and shared accounts are errors."""
    cals, found = [yaml.safe_load(t) for t in calendars], [yaml.safe_load(t) for t in clients]
    ids = [c.get("calendar_id") for c in cals]
    if len(set(ids)) != len(ids):
        raise ConfigError("a calendar is defined twice")
    for c in cals:
        if extra := set(c) - CALENDAR_KEYS:
            raise ConfigError(f"calendar {c.get('calendar_id')}: unknown {sorted(extra)}")
    owners: dict[str, str] = {}
    for c in found:
        name = c.get("client_id")
        if not name:
            raise ConfigError("a client has no id")
        if extra := set(c) - CLIENT_KEYS:
            raise ConfigError(f"client {name}: unknown {sorted(extra)}")
        if c.get("calendar") not in ids:
            raise ConfigError(f"client {name}: no calendar {c.get('calendar')}")
        for p in c.get("filename_patterns", []):
            try:
                re.compile(p["pattern"])
            except re.error as e:
                raise ConfigError(f"client {name}: pattern {p['pattern']}: {e}") from e
        for e in c.get("expectations", []):
            if e.get("domain") not in DOMAINS or e.get("cadence", "DAILY") not in CADENCES:
                raise ConfigError(f"client {name}: expectation {e}")
        for a in c.get("accounts", []):
            if owners.setdefault(a["account_id"], name) != name:
                raise ConfigError(f"account {a['account_id']} has two owners")
    return Registry(tuple(sorted(found, key=lambda c: c["client_id"])), tuple(cals))
