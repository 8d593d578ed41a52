"""Thresholds and switches a user may set; everything has the documented default."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from auditspark import fixed_values as fv


class SettingsError(ValueError):
    """A setting names an unknown rule or level."""


@dataclass(frozen=True)
class Settings:
    fail_on: str = "none"
    fail_on_new: str = "critical"
    enabled: dict = field(default_factory=dict)              # rule id -> bool
    severity_overrides: dict = field(default_factory=dict)   # rule id -> severity
    gate_additional_rules: tuple = ()
    allowed_hosts: tuple = ()
    pii_terms: tuple = ()
    runtime_suppress: tuple = ()                             # "RULE:agent" or "RULE:*"
    model_aliases: tuple = tuple(fv.FLOATING_ALIASES)
    ratio_threshold: float = fv.RATIO_THRESHOLD
    min_count: int = fv.MIN_COUNT
    approval_drop: float = fv.APPROVAL_DROP
    error_rate_elevated: float = fv.ERROR_RATE_ELEVATED
    error_rate_moderate: float = fv.ERROR_RATE_MODERATE
    max_file_bytes: int | None = None                       # no limit unless one is set
    declarations_path: str = "declared.toml"

    def __post_init__(self):
        for rule in [*self.enabled, *self.severity_overrides, *self.gate_additional_rules]:
            if not re.match(fv.RULE_ID_SHAPE, str(rule)) or rule not in fv.RULES:
                raise SettingsError(f"unknown rule id {rule!r}")
        for rule, severity in self.severity_overrides.items():
            if severity not in fv.SEVERITIES:
                raise SettingsError(f"unknown severity {severity!r} for {rule}")
        for name in ("fail_on", "fail_on_new"):
            if getattr(self, name) not in ("none", *fv.SEVERITIES):
                raise SettingsError(f"{name} must be none or a severity")
        for entry in self.runtime_suppress:
            rule, sep, target = entry.partition(":")
            if not sep or not target or rule not in fv.RULES:
                raise SettingsError(f"runtime suppression {entry!r} must look like RULE:agent or RULE:*")
        if self.ratio_threshold <= 1 or self.min_count < 0 or not 0 <= self.approval_drop <= 1:
            raise SettingsError("drift thresholds are out of range")

    def on(self, rule: str) -> bool:
        return self.enabled.get(rule, True)

    def rules_on(self, *rules: str) -> list[str]:
        return [r for r in rules if self.on(r)]

    def default_severity(self, rule: str) -> str:
        return self.severity_overrides.get(rule, fv.RULES[rule][2])


DEFAULT = Settings()
