"""What build files declare: dependencies, services, scripts, targets. One small file at a time."""

from __future__ import annotations

import json
import re

_TARGET = re.compile(r"^([A-Za-z0-9_.\-]+):(?:\s|$)")


def package_json(text: str) -> list[tuple[str, str, str]]:
    try:
        data = json.loads(text)
    except ValueError:
        return []
    out = []
    for key, kind in (("dependencies", "dependency"), ("devDependencies", "dev_dependency"), ("peerDependencies", "peer_dependency"), ("optionalDependencies", "optional_dependency"), ("scripts", "script")):
        block = data.get(key) if isinstance(data, dict) else None
        out += [(kind, name, str(value)) for name, value in block.items()] if isinstance(block, dict) else []
    return out


def go_mod(text: str) -> list[tuple[str, str, str]]:
    out, inside = [], False
    for raw in text.splitlines():
        line = raw.split("//", 1)[0].strip()
        if line.startswith("module "):
            out.append(("module", line.split(None, 1)[1], ""))
        elif re.match(r"require\s*\($", line):
            inside = True
        elif line == ")":
            inside = False
        elif line and (inside or line.startswith("require ")):
            name, _, version = line.removeprefix("require ").strip().partition(" ")
            out.append(("dependency", name, version.strip()))
    return out


def requirements(text: str) -> list[tuple[str, str, str]]:
    lines = (raw.strip() for raw in text.splitlines())
    parted = (re.match(r"([A-Za-z0-9_.\-\[\]]+)\s*(.*)$", line) for line in lines if line and not line.startswith(("#", "-")))
    return [("dependency", m[1], m[2].split(" #", 1)[0].strip()) for m in parted if m]


def makefile(text: str) -> list[tuple[str, str, str]]:
    names = {m[1] for line in text.splitlines() if not line.startswith("\t") and (m := _TARGET.match(line))}
    return [("target", n, "") for n in sorted(names)]


def compose(text: str) -> list[tuple[str, str, str]]:
    """Services with their keys: services stand at two blanks below `services:`, keys at four, list items at six."""
    out, section, service, key = [], "", "", ""
    for raw in text.splitlines():
        line = raw.rstrip()
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        name, colon, value = bare.partition(":")
        if indent == 0:
            section, service = name, ""
        elif section == "services" and indent == 2 and colon:
            service, key = name, ""
            out.append(("service", service, ""))
        elif section == "services" and service and indent == 4 and colon:
            key = name
            if value.strip():
                out.append((f"service.{key}", service, value.strip().strip("\"'")))
        elif section == "services" and service and key and indent >= 6:
            out.append((f"service.{key}", service, bare.removeprefix("- ").strip("\"'")))
    return out


def declared(path: str | None, text: str | None) -> list[tuple[str, str, str]]:
    """kind, name, value of what the file declares; nothing for other files, nulls and what can't be read."""
    if not path or not text:
        return []
    name = re.split(r"[\\/]", path)[-1].lower()
    if name == "package.json":
        return package_json(text)
    if name == "go.mod":
        return go_mod(text)
    if re.fullmatch(r"requirements.*\.txt", name):
        # Those of other folders are of what lies there.
        return requirements(text) if not re.search(r"[\\/]", path) else []
    if name in ("makefile", "gnumakefile"):
        return makefile(text)
    return compose(text) if re.fullmatch(r"(?:docker-)?compose(?:\..+)?\.ya?ml", name) else []
