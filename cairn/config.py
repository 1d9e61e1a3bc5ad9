"""Settings of an export: files with strict keys, layers that override each other, budgets by number or model."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field

# Keys of a project's settings file, with the type of each.
PROJECT_KEYS: dict[str, type] = {
    "export_profile": str, "safe_export_mode": str, "diff_export_mode": str, "diff_base_ref": str, "diff_target_ref": str, "redact_secrets": bool, "include_git_patch": bool, "include_project_in_zip": bool, "keep_staging_folder": bool, "text_file_size_limit_enabled": bool,
    "max_text_file_mb": int, "zip_part_limit_mb": int, "token_budget": int, "history_keep_last_n": int, "extra_ignored_dirs": list, "custom_excluded_files": list, "custom_excluded_extensions": list, "always_include_files": list, "always_include_dirs": list, "developer_context": str, "redaction_labels": bool,
}
# Profiles of reports.
PROFILES = ["quick", "full", "ai_review", "security", "minimal"]
#: Hexadecimal digits of a fingerprint in an allow list.
FINGERPRINT = re.compile(r"[0-9a-f]{16}")


class ConfigError(ValueError):
    """A settings file that can't be taken as it is."""


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e


def project_config(text: str) -> dict:
    """The settings of a project's file; unknown keys and values of another type are errors."""
    data = _toml(text)
    for key, value in data.items():
        want = PROJECT_KEYS.get(key)
        if want is None:
            raise ConfigError(f"unknown key {key}")
        if not isinstance(value, want) or want is int and (isinstance(value, bool) or value < 0) or want is list and not all(isinstance(x, str) for x in value):
            raise ConfigError(f"{key} must be {want.__name__}")
    return data


def allow_list(text: str) -> dict[str, str]:
    """fingerprint -> reason; unknown keys, missing reasons and malformed fingerprints are errors."""
    data = _toml(text)
    if extra := set(data) - {"schema_version", "allow"}:
        raise ConfigError(f"unknown key {min(extra)}")
    out = {}
    for entry in data.get("allow", []):
        if set(entry) != {"fingerprint", "reason"} or not all(isinstance(v, str) for v in entry.values()):
            raise ConfigError("an entry has a fingerprint and a reason")
        if not FINGERPRINT.fullmatch(entry["fingerprint"]):
            raise ConfigError(f"malformed fingerprint {entry['fingerprint']}")
        out[entry["fingerprint"]] = entry["reason"]
    return out


@dataclass
class UserProfiles:
    description: str = ""
    profiles: dict[str, dict] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def user_profiles(text: str | None) -> UserProfiles:
    """Profiles of a JSON file; entries without a name or that aren't objects of known settings are skipped and named."""
    if text is None:
        return UserProfiles()
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"user profiles: {e}") from e
    out = UserProfiles(data.get("description") if isinstance(data, dict) and isinstance(data.get("description"), str) else "")
    entries = data.get("profiles") if isinstance(data, dict) else None
    for name, value in entries.items() if isinstance(entries, dict) else ():
        if name.strip() and isinstance(value, dict):
            out.profiles[name.strip()] = value
        else:
            out.skipped.append(name)
    return out


def model_limits(text: str | None, defaults: dict[str, int]) -> dict[str, int]:
    """Context sizes of models: the defaults, overridden by a JSON object of whole numbers."""
    if text is None:
        return dict(defaults)
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"model limits: {e}") from e
    if not isinstance(data, dict) or not all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in data.values()):
        raise ConfigError("model limits are whole numbers by name")
    return defaults | data


def budget(text: str, limits: dict[str, int]) -> int:
    """Tokens of a budget: a number, one in thousands (k) or millions (m), or the name of a model.

    A model is taken by its exact name, then in any case, then by a part of its name if only one has it.
    """
    plain = text.strip()
    if not plain:
        raise ConfigError("a budget must not be empty")
    if plain[0].isdigit() or plain[0] in "+-":
        m = re.fullmatch(r"\+?(\d+)\s*([kKmM]?)", plain)
        if not m:
            raise ConfigError(f"{text} is no budget")
        return int(m[1]) * {"": 1, "k": 1000, "m": 1_000_000}[m[2].lower()]
    if plain in limits:
        return limits[plain]
    same = [n for n in sorted(limits) if n.lower() == plain.lower()]
    part = same[:1] or [n for n in sorted(limits) if plain.lower() in n.lower()]
    if len(part) != 1:
        raise ConfigError(f"{plain} is no model" if not part else f"{plain} may be any of {', '.join(part)}")
    return limits[part[0]]


def layered(*layers: dict | None) -> tuple[dict, dict[str, int]]:
    """Settings of which each later layer overrides the earlier ones, and the layer (from 0) that each is from. None and null values override nothing."""
    out, origin = {}, {}
    for k, layer in enumerate(layers):
        for key, value in (layer or {}).items():
            if value is not None:
                out[key], origin[key] = value, k
    return out, origin
